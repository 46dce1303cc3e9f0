"""Personal data in texts: generators propose spans, boosted trees choose (DataFrame and Spark ML only).

Four base kinds are found by fixed rules. Further generators propose spans of high recall, which may
overlap. Boosted trees see the format of a proposal and the characters around it; they learn from
proposals that the rules can judge: valid base spans against failed ones, and for every other kind spans
of valid form or behind a cue word against spans of another form. Thresholds per kind are read off held-back proposals at a target precision. Base spans always
stay; accepted proposals are added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import let, written

# Fixed patterns of the base kinds, in their order. The possessive and look-behind forms match the
# same spans as the plain ones but take linear time and no deep recursion on very long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSED = {
    "secret": r"(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|token|secret|api_?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+)",
    "account": r"(?<![0-9A-Za-z.+-])[0-9]{2,}+(?:[\x20./-][0-9]{2,}+){0,6}+(?![0-9A-Za-z])",
    "masked_email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]{1,24}){1,4}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
KINDS = (*BASE, *PROPOSED)
#: Texts without any of these hold no proposal.
HINT = r"[0-9@=:]|AKIA|[\[(]at[\])]"
CUES = r"(?i)mail|contact|phone|tel|call|fax|mobil|card|visa|credit|host|addr|login|user|pass|token|secret|key|konto|compte|cuenta|iban|ssn"

#: Right before an account, customer or phone number.
NUMBER_CUE = r"(?i)(?:account|acct|konto|kto|compte|cuenta|customer|client|kunden|phone|tel|call|fax|mobil|cell|card|visa)[\p{L}]{0,8}(?:[\x20.:#(]{0,3}(?:no|nr|num|number|n°|is))?[\x20.:#(=]{0,3}$"
DATE = r"^(?:(?:19|20)[0-9]{2}[\x20./-]?(?:0[1-9]|1[0-2])[\x20./-]?(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])[\x20./-]?(?:0[1-9]|1[0-2])[\x20./-]?(?:19|20)[0-9]{2})(?:[\x20./-][0-9]{2})*$"
#: Versions and other dotted short numbers; numbers without separators, or in fours.
DOTTED, PLAIN = r"^[0-9]{1,3}(?:\.[0-9]{1,3})+$", r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4})+)$"
#: Values that stand for a secret.
PLACEHOLDER = r"(?i)[=:]\x20{0,3}[\"']?(?:(.)\1*|[a-z_-]+)$"

TREES, DEPTH = 12, 4
PRECISION = 0.98
FEATURES = ("k", "chars", "digits", "letters", "uppers", "separators", "at", "equals", "groups", "luhn", "parts_fit", "form", "cue", "number_cue", "before_kind", "after_kind")


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (kind, start, end, m, before, after), in code points."""
    def located(pm):
        p, m = pm["p"], pm["m"]
        starts = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("s")),
            lambda acc, i: F.struct((acc["at"] + F.length(F.get(p, i)) + F.length(F.get(m, i))).alias("at"),
                                    F.concat(acc["s"], F.array(acc["at"] + F.length(F.get(p, i)))).alias("s")),
            lambda acc: acc["s"])
        return let(starts, lambda s: F.transform(m, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.get(s, i).alias("start"), (F.get(s, i) + F.length(x)).alias("end"), x.alias("m"),
            F.right(F.get(p, i), F.lit(24)).alias("before"), F.left(F.get(p, i + 1), F.lit(8)).alias("after"))))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,m:string,before:string,after:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(
        let(F.struct(F.split(text, pattern, -1).alias("p"), m.alias("m")), located)))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits holds."""
    n = F.length(digits)
    doubled = lambda d: d * 2 - F.when(d * 2 > 9, 9).otherwise(0)
    one = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, doubled(one(i))).otherwise(one(i))),
                        F.lit(0), lambda a, d: a + d)
    return F.when(n > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97(m: Column) -> Column:
    """Whether the check digits of an account number of letters and digits hold."""
    c = F.regexp_replace(m, "\\x20", "")
    turned = F.split(F.concat(F.substring(c, 5, 64), F.left(c, F.lit(4))), "")
    value = lambda x: F.when(x.rlike("^[0-9]$"), x.try_cast("int")).otherwise(F.ascii(x) - 55)
    rest = F.aggregate(F.filter(turned, lambda x: x != ""), F.lit(0), lambda a, x: let(value(x), lambda d: (a * F.when(d > 9, 100).otherwise(10) + d) % 97))
    return rest == 1


def form(rows_kind: Column, m: Column) -> Column:
    """Whether a proposal of a kind beyond the base has the form of that kind."""
    return (F.when(rows_kind == "iban", mod97(m)).when(rows_kind == "ssn", ~m.rlike("^(?:000|666|9)|-00-|-0000$"))
            .when(rows_kind == "masked_email", m.rlike("[A-Za-z]{2,24}$")).when(rows_kind == "secret", ~m.rlike(PLACEHOLDER))
            .when(rows_kind == "account", ~(m.rlike(DATE) | m.rlike(DOTTED))).otherwise(F.lit(False)))


def proposals(docs: DataFrame) -> DataFrame:
    """(doc_id, v, kind, start, end, m, before, after, valid): every proposal of every text; ``valid`` is the
    verdict of the base rules, null for other kinds."""
    d = docs.where(F.col("text").rlike(HINT)).select("doc_id", F.xxhash64("text").alias("v"), "text")
    every = F.concat(*[spans(F.col("text"), k, p) for k, p in {**BASE, **PROPOSED}.items()])
    rows = d.select("doc_id", "v", F.explode(every).alias("s")).select("doc_id", "v", "s.*")
    digits = F.regexp_replace("m", "[^0-9]", "")
    n = F.length(digits)
    parts = F.forall(F.split("m", "\\."), lambda x: let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))))
    valid = (F.when(F.col("kind") == "email", F.lit(True)).when(F.col("kind") == "ip", parts)
             .when(F.col("kind") == "card", n.between(12, 19) & luhn(F.substring(digits, 1, 20))).when(F.col("kind") == "phone", n.between(9, 15)))
    # short numbers are no proposals of their own
    wanted = F.when(F.col("kind").isin("card", "account"), n >= 7).otherwise(F.lit(True))
    return rows.where(wanted).withColumn("valid", valid)


def featured(rows: DataFrame) -> DataFrame:
    count = lambda p: F.regexp_count("m", F.lit(p)).cast("double")
    side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike("^[0-9]$"), 1).when(c.rlike("^\\p{L}$"), 2).when(c.rlike("^\\s$"), 3).otherwise(4).cast("double")
    digits = F.substring(F.regexp_replace("m", "[^0-9]", ""), 1, 40)
    parts = F.size(F.split("m", "\\.")) == 4
    small = F.forall(F.split("m", "\\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return rows.withColumns({
        "k": F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("double"), "chars": F.length("m").cast("double"),
        "digits": count("[0-9]"), "letters": count("\\p{L}"), "uppers": count("[A-Z]"), "separators": count("[ ().-]"), "at": count("@"),
        "equals": count("[=:]"), "groups": count("[0-9]+"), "luhn": (luhn(digits) & F.length(digits).between(12, 19)).cast("double"),
        "parts_fit": (parts & small).cast("double"), "cue": (F.col("before").rlike(CUES)).cast("double"),
        "form": form(F.col("kind"), F.col("m")).cast("double"), "number_cue": F.col("before").rlike(NUMBER_CUE).cast("double"),
        "before_kind": side(F.right("before", F.lit(1))), "after_kind": side(F.left("after", F.lit(1)))})


def judged(rows: DataFrame) -> DataFrame:
    """The proposals that the rules can judge, with ``label``; ``rows`` have features.

    Ends of phones with + are the base's and not judged, nor are numbers in groups without a cue word.
    """
    secret = F.col("m").rlike("AKIA[0-9A-Z]{16}|[=:]\\x20{0,3}[\"']?[0-9a-f]{16,}$")
    true, tail = F.col("form") == 1, F.col("before").rlike("\\+[0-9][\\x20().0-9-]*$")
    account = (F.when(tail, None).when(~true, 0.0).when((F.col("number_cue") == 1) | (F.col("luhn") == 1), 1.0).when(F.col("m").rlike(PLAIN), 0.0))
    label = (F.when(F.col("valid").isNotNull(), F.col("valid").cast("double")).when(F.col("kind") == "account", account)
             .when(F.col("kind") == "secret", F.when(~true, 0.0).when(secret, 1.0)).when(F.col("kind").isin("ssn", "iban", "masked_email"), F.col("form")))
    return rows.withColumn("label", label).where("label IS NOT NULL")


def training(rows: DataFrame) -> DataFrame:
    """Every judged proposal with features, ``label``, ``back`` (held back for the thresholds: a quarter, by text and start) and ``weight``:
    all kinds weigh the same, so that rare ones are learnt."""
    known = judged(featured(rows))
    totals = known.groupBy("kind").agg(F.count(F.lit(1)).alias("_n"))
    share = totals.join(totals.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_kinds"))).select("kind", (F.col("_all") / F.col("_kinds") / F.col("_n")).alias("weight"))
    return known.withColumn("back", F.pmod(F.xxhash64(F.lit(32), "doc_id", "start"), F.lit(4)) == 0).join(F.broadcast(share), "kind")


def chosen(rows: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``rows`` of proposals with ``accepted``: valid base spans, and what the trees accept; they learn from every judged proposal."""
    base = F.coalesce("valid", F.lit(False))
    fit = written(training(rows), "judged")
    if fit.where("NOT back").select("label").distinct().count() < 2:
        return rows.withColumn("accepted", base)
    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7, stepSize=0.3, cacheNodeIds=False, weightCol="weight")
    model = trees.fit(pack.transform(fit.where("NOT back")).select("features", "label", "weight"))
    limits = thresholds(_probability(model, pack, fit.where("back")), precision)
    limit = F.lit(2.0)
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(value)).otherwise(limit)
    return _probability(model, pack, featured(rows)).withColumn("accepted", base | (F.col("p") >= limit)).select(*rows.columns, "accepted")


def _probability(model: GBTClassificationModel, pack: VectorAssembler, rows: DataFrame) -> DataFrame:
    return model.transform(pack.transform(rows)).withColumn("p", F.get(vector_to_array("probability"), 1)).drop("features", "rawPrediction", "probability", "prediction")


def thresholds(held: DataFrame, precision: float, least: float = 0.5, cells: int = 200) -> dict[str, float]:
    """Per kind the lowest threshold whose held-back proposals above it have at least ``precision`` true ones.

    Kinds without a judged proposal take the threshold over all kinds; kinds that never reach it accept none."""
    cell = F.floor(F.col("p") * cells)
    counts = held.groupBy("kind", cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")).toPandas()  # kinds times cells at most
    found: dict[str, float] = {}
    for kind in (*KINDS, None):
        own = counts if kind is None else counts[counts["kind"] == kind]
        own = own.groupby("c")[["n", "s"]].sum().sort_index(ascending=False).cumsum()
        good = [c / cells for c, n, s in zip(own.index, own["n"], own["s"], strict=True) if s >= precision * n and c / cells >= least]
        found[kind] = min(good) if good else 2.0
    seen = set(counts["kind"])
    return {k: found[k] if k in seen else max(found[None], 0.9) for k in KINDS}


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, v, found: array of (start, o, kind, end, base) by start, then kind in the order of KINDS, then end.

    One row per distinct (doc_id, text); a null text is an empty one and has no spans; null ids are an id of
    their own; rows repeated whole come out once; other columns are ignored. Positions are code points, ends exclusive.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = written(proposals(texts), "proposals")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("o"), "kind", "end", F.coalesce("valid", F.lit(False)).alias("base"))
    kept = chosen(rows).where("accepted").select("doc_id", "v", span.alias("s"))
    every = texts.select("doc_id", F.xxhash64("text").alias("v"), F.lit(None).cast(kept.schema["s"].dataType).alias("s"))
    return every.unionByName(kept).groupBy("doc_id", "v").agg(F.sort_array(F.collect_set("s")).alias("found"))


def redacted(docs: DataFrame, found: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """doc_id, text with every span replaced by its mark; overlapping spans are replaced as one, under the first one's kind."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("v", F.xxhash64("text"))
    j = d.join(found.select(F.col("doc_id").alias("_d"), F.col("v").alias("_v"), "found"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("v") == F.col("_v")))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        head, tail = mark.split("{kind}")
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(head), s["kind"], F.lit(tail))
        inside = s["start"] < acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(put).alias("out"))

    text = F.aggregate("found", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return j.select("doc_id", text.alias("text"))
