"""Checks before a training run: rules of its configuration, loss masks of its examples, and the roll-up of all results."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.tokens import rendered, rendered_pieces

# Numeric fields that must be at least this large, and fields that must be above 0.
AT_LEAST = {
    "epochs": 1, "per_device_batch_size": 1, "grad_accum": 1, "max_seq_length": 256, "eval_steps": 1, "save_steps": 1, "early_stopping_patience": 1,
}
POSITIVE = ("lora_alpha", "seed", "learning_rate")
MASKINGS = ("assistant_only", "all")


def config_errors(configs: DataFrame, models: Iterable[str] | None = None) -> DataFrame:
    """configs with errors: the names of fields that break a rule, in the order of the rules, once each; no errors is an empty list.

    Fields that configs doesn't have aren't checked; a null breaks the rule of its field. models: base models that are known.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    broken: dict[str, Column] = {c: blank(c) for c in ("run_name", "base_model", "dataset_version") if c in configs.columns}
    if models is not None and "base_model" in broken:
        broken["base_model"] = broken["base_model"] | ~F.col("base_model").isin(*models)
    if "lora_r" in configs.columns:
        r = F.col("lora_r").cast("long")
        broken["lora_r"] = ~((r > 0) & (r.bitwiseAND(r - 1) == 0))
    broken |= {c: ~(F.col(c) > 0) for c in POSITIVE if c in configs.columns}
    if "lora_dropout" in configs.columns:
        broken["lora_dropout"] = ~F.col("lora_dropout").between(0, 1)
    broken |= {c: ~(F.col(c) >= low) for c, low in AT_LEAST.items() if c in configs.columns}
    if "loss_masking" in configs.columns:
        broken["loss_masking"] = ~F.col("loss_masking").isin(*MASKINGS)
    names = [F.when(F.coalesce(bad, F.lit(True)), F.lit(c)) for c, bad in broken.items()]
    return configs.withColumn("errors", F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>"))


def rolled_up(results: DataFrame, key: str = "run_id") -> DataFrame:
    """key, can_proceed (no critical check failed), all_passed and the codes of failed checks, of results (key, code, passed, critical).

    A check without an outcome has failed.
    """
    passed = F.coalesce("passed", F.lit(False))
    failed = F.array_sort(F.collect_set(F.when(~passed, F.col("code"))))
    return results.groupBy(key).agg(F.bool_and(passed | ~F.coalesce("critical", F.lit(False))).alias("can_proceed"), F.bool_and(passed).alias("all_passed"), failed.alias("failed"))


def assistant_spans(examples: DataFrame, ends: Callable[[Column], Column], pieces: Callable[[Column, Column], Column] = rendered_pieces) -> DataFrame:
    """``loss_spans`` in one pass: id, turn, start, stop. A conversation is rendered once, in pieces, and counted once.

    ends: for each piece how much of the whole ends with it or before, such as ``tokens.piece_ends``; pieces: of messages and tools, the
    part before the turns first, such as ``templates.pieces``. Equal to counting every prefix where no token reaches
    across the end of a turn, which special tokens at both sides of it prevent.
    """
    counted = examples.select("id", "messages", ends(pieces(F.col("messages"), F.col("tools"))).alias("ends"))
    turns = counted.select("id", "ends", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    start = F.when(F.col("turn") == 0, F.lit(0)).otherwise(F.get("ends", F.col("turn"))).cast("long")
    return turns.select("id", "turn", start.alias("start"), F.get("ends", F.col("turn") + 1).alias("stop")).where("stop > start")


def loss_spans(examples: DataFrame, count: Callable[[Column], Column]) -> DataFrame:
    """id, turn, start, stop: the tokens that each assistant turn adds to the rendered example, the only ones that training learns from.

    The definition by prefixes, each of which is rendered and counted: for tests; ``assistant_spans`` is the one for data.
    count: tokens of a rendered text, such as ``tokens.token_count``. A turn that adds none has no row; stop is never beyond the whole.
    """
    turns = examples.select("id", "messages", "tools", F.posexplode("messages").alias("turn", "m")).where("m.role = 'assistant'")
    upto = lambda n: count(rendered(F.slice("messages", 1, n), F.col("tools")))
    spans = turns.select(
        "id", "turn", F.when(F.col("turn") == 0, F.lit(0)).otherwise(upto(F.greatest(F.col("turn"), F.lit(1)))).cast("long").alias("start"),
        F.least(upto(F.col("turn") + 1), count(rendered(F.col("messages"), F.col("tools")))).cast("long").alias("stop"),
    )
    return spans.where("stop > start")


def unmasked(examples: DataFrame, spans: DataFrame) -> DataFrame:
    """Ids of examples of which training would learn nothing."""
    return examples.select("id").join(spans.select("id"), "id", "left_anti")
