"""Row contracts: violations come out as rows, nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.functions.inventory import DELETE
from strophe.functions.texts import stable_id


def prediction_violations(df: DataFrame, key: Sequence[str], inventory: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """One row per (key, code) for every broken rule of the frozen prediction contract.

    Needs ``method, cohort, fold, grp, event, target, idx, gold_event, realized, gop,
    p_error, p_alt, margin, top_alt`` and ``candidates`` (map symbol -> probability).
    """
    names = list(inventory)
    probs = F.map_values("candidates")
    entries = F.transform(F.map_entries("candidates"), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("c")))
    ranked = F.array_sort(entries)
    best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    expected = F.array_sort(F.filter(F.array(*[F.lit(s) for s in [*names, DELETE]]), lambda s: s != F.col("target")))
    total = F.aggregate(probs, F.lit(0.0), lambda a, v: a + v)

    def unit(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)

    event, realized, target = F.col("gold_event"), F.col("realized"), F.col("target")
    rules: dict[str, Column] = {
        f"empty_{c}": F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
        for c in ("method", "cohort", "fold", "grp", "event", "target")
    }
    rules |= {
        "negative_index": F.coalesce(F.col("idx") < 0, F.lit(True)),
        "unknown_event": ~F.coalesce(event.isin("match", "substitution", "deletion"), F.lit(False)),
        "unknown_target": ~F.coalesce(target.isin(names), F.lit(False)),
        "match_realized": (event == "match") & ~F.coalesce(realized == target, F.lit(False)),
        "substitution_realized": (event == "substitution")
        & ~F.coalesce(realized.isin(names) & (realized != target), F.lit(False)),
        "deletion_realized": (event == "deletion") & realized.isNotNull() & (realized != DELETE),
        "gop_not_finite": F.col("gop").isNull() | F.isnan("gop") | (F.abs("gop") == float("inf")),
        "p_error_range": ~unit(F.col("p_error")),
        "p_alt_range": ~unit(F.col("p_alt")),
        "margin_range": ~unit(F.col("margin")),
        "candidate_set": F.array_sort(F.map_keys("candidates")) != expected,
        "candidate_range": F.exists(probs, lambda v: ~unit(v)),
        "candidate_sum": F.abs(total - 1) > tol,
        "top_candidate": F.col("top_alt") != best["c"],
        "p_alt_mismatch": F.abs(F.col("p_alt") + best["p"]) > tol,
        "margin_mismatch": F.abs(F.col("margin") - (second["p"] - best["p"])) > tol,
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda c: c.isNotNull())
    return df.select(*key, F.explode(codes).alias("violation"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_holes(df: DataFrame, event: Sequence[str], idx: str) -> DataFrame:
    """Events whose indices are not exactly 0..max, each once."""
    out = df.groupBy(*event).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(idx).alias("n_distinct"),
        F.min(idx).alias("first"), F.max(idx).alias("last"))
    return out.where((F.col("first") != 0) | (F.col("last") != F.col("n") - 1) | (F.col("n_distinct") != F.col("n")))


def unequal_lengths(df: DataFrame, key: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """Rows whose per-position arrays differ in length."""
    sizes = F.array(*[F.coalesce(F.size(a), F.lit(-1)) for a in arrays])
    return df.where(F.array_min(sizes) != F.array_max(sizes)).select(*key, *[F.size(a).alias(f"n_{a}") for a in arrays])


def normalization_violations(df: DataFrame, key: Sequence[str], tol: float = 1e-7) -> DataFrame:
    """Posteriors must sum to one, the substitution mass to its parts, accepted symbols to zero.

    Needs ``ok, sub, del``, ``sub_parts`` (array of mass by symbol id - 1) and ``accepted``
    (array of symbol ids).
    """
    add = lambda a, v: a + v
    parts = F.aggregate("sub_parts", F.lit(0.0), add)
    leaked = F.exists("accepted", lambda i: F.abs(F.element_at("sub_parts", i.cast("int"))) > 1e-10)
    rules = {
        "event_sum": F.abs(F.col("ok") + F.col("sub") + F.col("del") - 1) > tol,
        "substitution_marginal": F.abs(parts - F.col("sub")) > tol,
        "accepted_mass": leaked,
    }
    codes = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda c: c.isNotNull())
    return df.select(*key, F.explode(codes).alias("violation"))


# Field names that must not reach a runtime table.
FORBIDDEN_FIELDS = (
    "speaker", "speaker_id", "patient", "patient_id", "participant", "participant_id", "severity", "severity_rank",
    "fold", "cohort", "event", "utterance_id", "phn", "phn_path", "textgrid", "textgrid_path", "audio_path", "wav_path",
    "raw_gop", "gop", "candidate_probabilities", "candidate_scores", "gold_event", "gold_realized", "ground_truth",
    "reference_label", "stable",
)


def schema_fields(schema: T.DataType, path: str = "") -> list[tuple[str, str, T.DataType]]:
    """(path, name, type) of every field at any depth."""
    out = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            here = f"{path}.{f.name}" if path else f.name
            out.append((here, f.name, f.dataType))
            out += schema_fields(f.dataType, here)
    elif isinstance(schema, T.ArrayType):
        out += schema_fields(schema.elementType, path + "[]")
    return out


def leak_report(df: DataFrame, value_patterns: dict[str, str]) -> DataFrame:
    """(field, finding, n): forbidden field names and top-level values matching a pattern."""
    named = []
    for path, name, _ in schema_fields(df.schema):
        low = name.lower()
        if low in FORBIDDEN_FIELDS or "gold" in low or low.endswith("_path") or low.startswith("raw_"):
            named.append(path)
    texts = [p for p, _, t in schema_fields(df.schema) if isinstance(t, T.StringType) and "[]" not in p]
    # One pass with a conditional count per check; only the single result row is unfolded.
    checks = [(c, n, F.count_if(F.coalesce(F.col(c).rlike(p), F.lit(False)))) for c in texts for n, p in value_patterns.items()]
    checks += [(p, "forbidden_name", F.count(F.lit(1))) for p in named]
    if not checks:
        return df.sparkSession.createDataFrame([], "field string, finding string, n bigint")
    wide = df.agg(*[e.alias(f"_n{i}") for i, (_, _, e) in enumerate(checks)])
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("finding"), F.col(f"_n{i}").alias("n")) for i, (f, k, _) in enumerate(checks)])
    return wide.select(F.explode(cells).alias("_c")).select("_c.*").where("n > 0")


def decision_record(df: DataFrame, gate: float | None, min_margin: float = 0.1, threshold: float = 0.5) -> DataFrame:
    """Decision and permission flags of a runtime record.

    Below the threshold the position is correct; above it a specific statement needs the
    gate (none means never); missing evidence abstains. Needs ``p_error, p_alt, margin,
    top_alt, target``.
    """
    allowed = F.lit(False) if gate is None else (
        (F.col("p_alt") >= gate) & (F.col("margin") >= min_margin) & F.col("top_alt").isNotNull()
        & (F.col("top_alt") != F.col("target")))
    decision = (F.when(F.col("p_error").isNull(), "abstain")
                .when(F.col("p_error") < threshold, "correct")
                .when(F.coalesce(allowed, F.lit(False)), F.when(F.col("top_alt") == DELETE, "deletion").otherwise("substitution"))
                .otherwise("atypical_unspecified"))
    specific = F.col("decision").isin("substitution", "deletion")
    return df.withColumn("decision", decision).withColumns({
        "alternative": F.when(specific, F.col("top_alt")),
        "alternative_probability": F.when(specific, F.col("p_alt")),
        "abstain": F.col("decision") == "abstain",
        "mention_error": F.col("decision").isin("substitution", "deletion", "atypical_unspecified"),
        "mention_alternative": specific,
    })


def runtime_ids(df: DataFrame, group: str, event: str, idx: str, target: str, namespace: str) -> DataFrame:
    """Recording id and position id; the position id is derived from the recording id."""
    df = df.withColumn("recording_ref", stable_id("utt", [F.col(group), F.col(event)], namespace))
    return df.withColumn("position_ref", stable_id("phone", [F.col("recording_ref"), F.col(idx), F.col(target)], namespace))
