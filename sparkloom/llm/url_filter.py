"""URL rules as a sorted digest array: 64-bit xxhash keys in a memory-mapped file, probed by vectorised binary search.

A rule is ``host/path-prefix``. Rules may be many: they are hashed and sorted by Spark's driver into one file of keys,
one of offsets and one of the full strings in the shared folder; tasks map these files, or the one copy that an executor makes of files
on another store, and confirm every key that is found against the stored string, so a collision of digests never decides.
"""

from __future__ import annotations

import io
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.store import new_dir

MAX_RULE_BYTES = 4 << 30
ALLOW, BLOCK = "allow", "block"
BATCH = 4096


def digests(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k.encode()) for k in keys), np.uint64, len(keys))


def build(spark: SparkSession, rules: Iterator[tuple[str, str]], path: str | None = None) -> str:
    """Writes the rules (verdict, ``host/path-prefix``) as a digest array below ``path``; returns the folder.

    A rule needs a host and a ``/``; hosts are lower-cased A-Z. A rule given twice must have the same verdict. No rules give
    an index that matches nothing. ValueError if the strings exceed MAX_RULE_BYTES.
    """
    found: dict[str, str] = {}
    for verdict, rule in rules:
        host, slash, rest = rule.partition("/")
        if verdict not in (ALLOW, BLOCK) or not host or not slash:
            raise ValueError(f"not a rule: {verdict} {rule}")
        rule = _lower(host) + "/" + rest
        if found.setdefault(rule, verdict) != verdict:
            raise ValueError(f"{rule} is both allowed and blocked")
    keys = list(found)
    if sum(map(len, keys)) > MAX_RULE_BYTES:
        raise ValueError("too many rules for one digest array")
    h = digests(keys)
    order = np.argsort(h, kind="stable")
    texts = [keys[k].encode() for k in order]
    path = path or new_dir(spark, "url-rules")
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base)
    hosts = [k.partition("/")[0] for k in keys]
    for name, array in (
        ("keys", h[order]), ("offsets", np.cumsum([0, *map(len, texts)]).astype(np.int64)),
        ("blocks", np.array([found[keys[k]] == BLOCK for k in order], bool)), ("strings", np.frombuffer(b"".join(texts) or b"", np.uint8)),
        ("path_lengths", np.unique([len(k) - len(x) - 1 for k, x in zip(keys, hosts, strict=True)]).astype(np.int64)),
        ("labels", np.unique([x.count(".") + 1 for x in hosts]).astype(np.int64)),
    ):
        out = io.BytesIO()
        np.save(out, array)
        with fs.open_output_stream(f"{base}/{name}.npy") as f:
            f.write(out.getvalue())
    return path


def _lower(host: str) -> str:
    return host.translate(_UPPER)


_UPPER = {k: k + 32 for k in range(65, 91)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path: after the first ``://`` up to ``/``, ``?``, ``#``; then up to ``?`` or ``#``. Else both empty."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return _lower(host), slash + path


def copied(fs: pafs.FileSystem, base: str) -> str:
    """A folder with a copy of an index, in the folder that Spark keeps for the files of an executor: made by the first worker there, mapped by all."""
    root = SparkFiles.getRootDirectory()
    made = fs.get_file_info(f"{base}/labels.npy").mtime_ns  # the file that is written last
    folder = os.path.join(root, f"url-rules-{xxhash.xxh3_64_hexdigest(f'{base} {made}')}")
    if not os.path.isdir(folder):
        part = tempfile.mkdtemp(dir=root)
        pafs.copy_files(base, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        try:
            os.rename(part, folder)
        except OSError:  # another worker was faster
            shutil.rmtree(part)
    return folder


class Index:
    def __init__(self, path: str):
        fs, base = pafs.FileSystem.from_uri(path)
        folder = base if isinstance(fs, pafs.LocalFileSystem) else copied(fs, base)
        for name in ("keys", "offsets", "blocks", "strings", "path_lengths", "labels"):
            setattr(self, name, np.load(f"{folder}/{name}.npy", mmap_mode="r"))

    def find(self, probes: list[str]) -> np.ndarray:
        """Row of each full string, or -1."""
        h = digests(probes)
        at = np.searchsorted(self.keys, h)
        out = np.full(len(probes), -1, np.int64)
        inside = np.flatnonzero(at < len(self.keys))
        for k in inside[self.keys[at[inside]] == h[inside]].tolist():
            row, text = int(at[k]), probes[k].encode()
            while row < len(self.keys) and self.keys[row] == h[k]:
                if bytes(self.strings[self.offsets[row] : self.offsets[row + 1]]) == text:
                    out[k] = row
                    break
                row += 1
        return out

    def judge(self, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str]]:
        split = [parts(u) for u in urls]
        probes, owner = [], []
        labels, lengths = set(self.labels.tolist()), self.path_lengths.tolist()
        most = max(labels, default=0)
        for k, (host, path) in enumerate(split):
            if not host or not path:
                continue
            name = host.split(".")
            for n in range(1, min(most, len(name)) + 1):
                if n in labels:
                    suffix = ".".join(name[-n:])
                    for m in lengths:
                        if m < len(path):
                            probes.append(suffix + path[: m + 1])
                            owner.append(k)
        best: list[tuple[int, int, str] | None] = [None] * len(urls)
        for k, probe, row in zip(owner, probes, self.find(probes).tolist(), strict=True):
            if row >= 0 and (best[k] is None or len(probe) > best[k][0]):
                best[k] = (len(probe), row, probe)
        return [h for h, _ in split], [p for _, p in split], [b and b[2] for b in best], [BLOCK if b and self.blocks[b[1]] else ALLOW for b in best]


def judge(pages: DataFrame, index_path: str, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of pages: id, host, path, the longest rule that fits (or null) and the verdict; without a rule: allow.

    A rule fits its host and all subdomains if the path starts with the rule's. Null urls and those without ``://`` have
    an empty host and path and fit no rule; ids may be null or repeat. Other columns aren't read.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for whole in batches:
            index = index or Index(index_path)
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                out = index.judge(batch.column("url").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.string()) for x in out)], ["id", "host", "path", "rule", "verdict"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
