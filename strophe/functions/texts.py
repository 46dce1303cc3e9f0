"""Text predicates and keys as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.inventory import (
    IMAGE_SUFFIXES,
    IPA_IGNORED,
    IPA_SEQUENCES,
    IPA_SYMBOLS,
    NOISE_TEXTS,
    PHONES,
    PROJECTION,
    literal_map,
)

# Every character that counts as white space in a Unicode text.
SPACES = r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
WORD = r"[a-z0-9]+(?:['.-][a-z0-9]+)*"


def normalize_text(x: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), SPACES, " "))


def text_reason(x: Column) -> Column:
    """First reason a text is unusable as a reading prompt, null when it is fine."""
    text = normalize_text(x)
    lower = F.lower(text)
    image = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        image = image | lower.contains(suffix)
    return (F.when(lower.isin(list(NOISE_TEXTS)), "empty_or_noise")
            .when(text.startswith("["), "elicitation_instruction")
            .when(image, "picture_prompt")
            .when(~text.rlike("[A-Za-z]"), "no_english_letters"))


def words(x: Column) -> Column:
    """Lower-case word tokens; a curly apostrophe counts as a straight one."""
    return F.regexp_extract_all(F.lower(F.replace(x, F.lit("’"), F.lit("'"))), F.lit(WORD), F.lit(0))


def control_chars(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(CONTROLS), F.lit(0))))


def non_ascii_chars(x: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(x, F.lit(r"[^\x00-\x7f]"), F.lit(0))))


# Limits of an entered text.
LIVE_CHARS, LIVE_POSITIONS = 500, 80


def live_text_reason(x: Column, positions: Column, max_chars: int = LIVE_CHARS, max_positions: int = LIVE_POSITIONS) -> Column:
    """Why an entered text is refused, null when it may be assessed."""
    text = F.trim(F.regexp_replace(F.regexp_replace(x, "^" + SPACES, ""), SPACES + "$", ""))
    foreign = F.regexp_replace(text, r"[\x00-\x7f]", "").rlike(r"[\p{L}\p{N}]")
    return (F.when((text == "") | (F.length(text) > max_chars), "length")
            .when(foreign, "non_ascii_letters")
            .when(text.rlike(CONTROLS), "control_characters")
            .when(positions > max_positions, "too_many_positions"))


def event_key(*parts: Column, sep: str = "|") -> Column:
    """Composite key; null when a part is empty or contains the separator."""
    clean = [F.trim(p.cast("string")) for p in parts]
    bad = F.lit(False)
    for p in clean:
        bad = bad | F.coalesce((p == "") | p.contains(sep), F.lit(True))
    return F.when(~bad, F.concat_ws(sep, *clean))


def split_event_key(key: Column, names: Sequence[str], sep: str = "|") -> list[Column]:
    parts = F.split(key, "\\" + sep)
    ok = F.size(parts) == len(names)
    return [F.when(ok, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]


def group_prefix(x: Column) -> Column:
    """Leading letters of ids of the form LETTERS+DIGITS, null for other shapes."""
    up = F.upper(x)
    return F.when(up.rlike("^[A-Z]+[0-9]+$"), F.regexp_extract(up, "^([A-Z]+)", 1))


# Grade letters.
GRADES = {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0, "e": 5.0}


def grade_score(x: Column) -> Column:
    """Mean of the known grade letters of ``a/b``-style grades, null if none is known."""
    parts = F.split(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("/")), "/")
    known = F.filter(F.transform(parts, lambda p: F.element_at(literal_map(GRADES), F.lower(F.trim(p)))),
                     lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), F.size(known).cast("double"))


def normalize_symbol(
    label: Column, dropped: Sequence[str], allophones: Mapping[str, str], inventory: Sequence[str],
    projection: Mapping[str, str] | None = None,
) -> Column:
    """Struct (symbol, status): status is ok, dropped or unknown."""
    raw = F.regexp_replace(F.lower(F.trim(label)), "[0-9]+$", "")
    drop = raw.isin(list(dropped))
    symbol = F.coalesce(F.element_at(literal_map(allophones), raw), F.upper(raw))
    if projection:
        symbol = F.coalesce(F.element_at(literal_map(projection), symbol), symbol)
    known = symbol.isin(list(inventory))
    return F.struct(
        F.when(~drop & known, symbol).alias("symbol"),
        F.when(drop, "dropped").when(known, "ok").otherwise("unknown").alias("status"),
    )


def _clean_ipa(token: Column) -> Column:
    return F.regexp_replace(F.trim(token), "[" + "".join(IPA_IGNORED) + "]", "")


def map_ipa_tokens(tokens: Column) -> Column:
    """Struct (symbols, unknown) for an array of phonetic tokens.

    A token maps to one or more phones; a trailing length mark may be dropped; phone names
    pass through. Tokens without a mapping are reported, not skipped silently.
    """
    project = {**{p: (p,) for p in PHONES}, **{k: (v,) for k, v in PROJECTION.items()}}
    table = {k: (v,) for k, v in IPA_SYMBOLS.items()}
    table.update(IPA_SEQUENCES)
    table = {k: tuple(PROJECTION.get(p, p) for p in v) for k, v in table.items()}
    lookup, names = literal_map(table), literal_map(project)

    def symbols(token: Column) -> Column:
        clean = _clean_ipa(token)
        short = F.when(clean.endswith("ː"), F.element_at(lookup, F.rtrim(clean, F.lit("ː"))))
        return F.coalesce(F.element_at(lookup, clean), F.element_at(names, F.upper(clean)), short)

    mapped = F.transform(tokens, lambda t: F.struct(_clean_ipa(t).alias("token"), symbols(t).alias("symbols")))
    good = F.filter(mapped, lambda m: m["symbols"].isNotNull())
    bad = F.filter(mapped, lambda m: m["symbols"].isNull())
    return F.struct(
        F.flatten(F.transform(good, lambda m: m["symbols"])).alias("symbols"),
        F.transform(bad, lambda m: m["token"]).alias("unknown"),
    )


def json_value(x: Column) -> Column:
    """One value as JSON text."""
    wrapped = F.to_json(F.array(x))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


# Fixed value: name of the id scheme, part of every hashed text.
ID_SCHEME = "local_deterministic_sha256.v1"


def stable_id(kind: str, parts: Sequence[Column], namespace: str, length: int = 20) -> Column:
    """Deterministic id: SHA-256 over canonical JSON (sorted keys, no blanks) of the parts."""
    body = F.concat(
        F.lit(f'{{"kind":"{kind}","namespace":"{namespace}","parts":['),
        F.concat_ws(",", *[json_value(p) for p in parts]),
        F.lit(f'],"scheme":"{ID_SCHEME}"}}\n'),
    )
    return F.concat(F.lit(kind + "_"), F.substring(F.sha2(body, 256), 1, length))




def word_counts(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, n_words, n_distinct, first_sorted, last_sorted, position_weight) of arrays of words; keys without a word are left out.

    Rows are counted by themselves, only numbers and two words of a row are shuffled. Words of several rows of one key are counted apart, as
    these rows may share words; null is a key like any other.
    """
    w = F.coalesce(F.col(words), F.array().cast("array<string>"))
    weights = F.aggregate(F.transform(w, lambda x, i: ((i + 1) * F.length(x)).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    rows = df.select(key, F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                     F.array_min(w).alias("first_sorted"), F.array_max(w).alias("last_sorted"), weights.alias("position_weight"))
    per = rows.groupBy(key).agg(F.sum("n_words").alias("n_words"), F.sum("n_distinct").alias("n_distinct"), F.min("first_sorted").alias("first_sorted"),
                                F.max("last_sorted").alias("last_sorted"), F.sum("position_weight").alias("position_weight"), F.count(F.lit(1)).alias("_rows"))
    shared = per.where("_rows > 1").select(F.col(key).alias("_key"))
    again = df.join(shared, F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, F.explode(words).alias("_word"))
    exact = again.distinct().groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    out = per.where("n_words > 0").join(exact, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.select(key, "n_words", F.coalesce("_n", "n_distinct").alias("n_distinct"), "first_sorted", "last_sorted", "position_weight")
