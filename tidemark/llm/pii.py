"""Personal data: fixed forms, and bootstrapped contextual extraction of identifiers that no fixed form covers.

Base forms (e-mail addresses, IP addresses, card and phone numbers) are the seed entities. The words next to them are the lexical patterns
they induce: (kind, side, word). Patterns and instances form a graph whose edges are the
corpus's occurrences. In every round a pattern's confidence for a kind is the share of all words that stand in
its place, anywhere in the corpus, that are instances of the kind, weighted by their scores; an instance's score is the
noisy-or of its patterns. Identifier-like words that stand in a pattern of high confidence are found as personal data.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._common import drop, save

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct seeds that a pattern needs; confidence from which a pattern finds new identifiers.
ROUNDS, SUPPORT, SURE = 3, 3, 0.5
#: Code points on either side of an entity that are looked at for its neighbouring word; longer words are no context.
SIDE = 64

# A run of name characters can only match from its start (or from where the last match ended), so no run is tried twice.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Identifier-like words: with a digit or an at sign.
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)


_SPAN = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is named: as a lambda's argument."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Matches that are placed by one fold; a fold copies what it has for each match, so long lists are cut into parts of this size.
_PART = 128


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches with code points of start and end, and the text just before and after each."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def placed(x: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            m, before, after = F.get(x["found"], i), F.get(x["between"], i), F.get(x["between"], i + 1)
            s = acc["at"] + F.length(before)
            e = s + F.length(m)
            span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), m.alias("m"), F.right(before, F.lit(SIDE)).alias("l"), F.left(after, F.lit(SIDE)).alias("r"))
            return F.struct(e.alias("at"), F.array_append(acc["out"], span).alias("out"))

        n = F.size(x["found"])
        firsts = F.sequence(F.lit(0), F.floor((n - 1) / _PART).cast("int"))
        # every part from 0, then moved to where the parts before it end
        parts = F.transform(firsts, lambda p: F.aggregate(F.sequence(p * _PART, F.least(n, (p + 1) * _PART) - 1), start, add))

        def moved(parts: Column) -> Column:
            begins = F.aggregate(parts, F.array(F.lit(0)), lambda at, p: F.array_append(at, F.element_at(at, -1) + p["at"]))

            def shifted(p: Column, base: Column) -> Column:
                return F.transform(p["out"], lambda b: F.struct((b["s"] + base).alias("s"), b["k"].alias("k"), (b["e"] + base).alias("e"), b["m"].alias("m"), b["l"].alias("l"), b["r"].alias("r")))

            return F.flatten(F.zip_with(parts, F.slice(begins, 1, F.size(parts)), shifted))

        return F.when(n > 0, _bound(parts, moved)).otherwise(none)

    return _bound(both, placed)


def _checks(kind: str):
    return lambda x: _valid(kind, x["m"])


def _is(k: int):
    return lambda b: b["k"] == k


def _base(text: Column) -> Column:
    """All valid base spans, by start, then kind as listed."""
    every = []
    for k, kind in enumerate(KINDS):
        hint = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike("[0-9]")
        found = F.when(hint, _matches(text, _PATTERNS[kind], k)).otherwise(F.array().cast(_SPAN))
        every.append(F.filter(found, _checks(kind)))
    return F.array_sort(F.concat(*every))


def _word_before(side: Column) -> Column:
    """The word that a text ends with (but for space), lower-cased; null if there is none or it may be cut off."""
    w = F.element_at(F.split(F.rtrim(F.regexp_replace(side, r"\s", " ")), " ", -1), -1)
    return F.when((w != "") & (F.length(w) < SIDE - 1), F.lower(w))


def _word_after(side: Column) -> Column:
    w = F.element_at(F.split(F.ltrim(F.regexp_replace(side, r"\s", " ")), " ", -1), 1)
    return F.when((w != "") & (F.length(w) < SIDE - 1), F.lower(w))


def scan(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, g, base, other): a hash of the text, and every row's base spans and its other identifier-like words. Narrow."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    words = F.when(F.col("text").rlike("[0-9@]"), _matches(F.col("text"), _CANDIDATE, -1)).otherwise(F.array().cast(_SPAN))

    def core(c: Column) -> Column:
        """The identifier in a word: without the marks around it."""
        lead = F.length(F.regexp_extract(c["m"], r"\A[^A-Za-z0-9+@]*+", 0))
        inner = F.regexp_replace(F.regexp_replace(c["m"], r"\A[^A-Za-z0-9+@]++", ""), r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++\z", "")
        return _bound(F.struct(lead.alias("lead"), inner.alias("inner")), lambda x: F.struct((c["s"] + x["lead"]).alias("s"), c["k"].alias("k"), (c["s"] + x["lead"] + F.length(x["inner"])).alias("e"), F.lower(x["inner"]).alias("m"), c["l"].alias("l"), c["r"].alias("r")))

    def free(x: Column) -> Column:
        apart = F.filter(F.transform(x["words"], core), lambda c: (c["e"] > c["s"]) & ~F.exists(x["base"], lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        return F.struct(x["base"].alias("base"), apart.alias("other"))

    # base and words are computed once for each text, not for each word
    found = _bound(F.struct(_base(F.col("text")).alias("base"), words.alias("words")), free)
    return rows.select("rid", "doc_id", F.xxhash64("text").alias("g"), found.alias("found")).select("rid", "doc_id", "g", "found.base", "found.other")


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, total): how often each word (by its hash) stands anywhere in the corpus; counted in each partition before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"\s+")).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").alias("h")).agg(F.count(F.lit(1)).alias("total"))
    return counts


def discover(found: DataFrame, docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """(rid, s, e, k): spans that high-confidence patterns find beyond the base. found: :func:`scan`'s result, written."""
    spark = found.sparkSession
    seen = found.select("rid", F.explode("base").alias("b")).select("rid", "b.s", "b.e", "b.k", F.lower("b.m").alias("x"), "b.l", "b.r")
    new = found.select("rid", F.explode("other").alias("b")).select("rid", "b.s", "b.e", "b.k", F.col("b.m").alias("x"), "b.l", "b.r")
    hashed = F.array(F.struct(F.lit("L").alias("side"), _word_before(F.col("l")).alias("w")), F.struct(F.lit("R").alias("side"), _word_after(F.col("r")).alias("w")))

    def edges(rows: DataFrame) -> DataFrame:
        return rows.withColumn("c", F.explode(hashed)).where("c.w is not null").select("rid", "s", "e", "k", F.xxhash64("x").alias("x"), F.col("c.side").alias("side"), F.xxhash64("c.w").alias("h"))

    seeds = save(edges(seen).groupBy("k", "side", "h", "x").agg(F.count(F.lit(1)).alias("n")), "pii-seeds", spark)
    wanted = edges(new)
    # only patterns that seeds induce are kept, and only they are counted over the corpus
    induced = seeds.select("side", "h").distinct()
    sites = save(wanted.join(induced, ["side", "h"], "left_semi"), "pii-sites", spark)
    # an inner join: a semi-join would be pushed below the count, and every word of the corpus would be shuffled
    totals = word_counts(docs).join(induced.select("h").distinct(), "h")
    totals = save(totals, "pii-totals", spark)
    unseen = sites.groupBy("side", "h", "x").agg(F.count(F.lit(1)).alias("n"))
    confidence = None
    for _ in range(rounds):
        known = seeds.withColumn("score", F.lit(1.0))
        if confidence is not None:
            scored = unseen.join(confidence, ["side", "h"]).groupBy("k", "x").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
            known = known.unionByName(unseen.join(scored.where(F.col("score") >= sure), "x").select("k", "side", "h", "x", "n", "score"))
        weight = known.groupBy("k", "side", "h").agg(F.sum(F.col("n") * F.col("score")).alias("held"), F.countDistinct("x").alias("support"))
        fresh = weight.where(F.col("support") >= support).join(totals, "h").select("k", "side", "h", (F.col("held") / F.greatest(F.col("total"), F.col("held"))).alias("confidence"))
        fresh = save(fresh.where(F.col("confidence") > 0.05), "pii-patterns", spark)
        if confidence is not None:
            drop(confidence)
        confidence = fresh
    best = sites.drop("k").join(confidence.where(F.col("confidence") >= sure), ["side", "h"])
    best = best.groupBy("rid", "s", "e").agg(F.max(F.struct("confidence", (-F.col("k")).alias("k"))).alias("b"))
    out = save(best.select("rid", "s", "e", (-F.col("b.k")).alias("k")), "pii-found", spark)
    drop(seeds, sites, totals, confidence)
    return out


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE) -> DataFrame:
    """(rid, doc_id, base, spans): every row of ``docs`` with its base spans and all spans, as arrays of structs (s, k, e) by start, then
    kind: code points, end exclusive.

    Base forms are found leftmost and without overlap for each kind, over the whole text; different kinds may overlap.
    Spans that patterns add overlap no base span. A null or empty text has none; a null doc_id and repeated rows stay as
    they are; an empty table gives an empty one; other columns are ignored.
    """
    found = save(scan(docs), "pii-scan", docs.sparkSession)
    added = discover(found, docs, rounds, support, sure).groupBy("rid").agg(F.collect_list(F.struct("s", "k", "e")).alias("added"))
    out = found.select("rid", "doc_id", F.transform("base", _slim).alias("base")).join(added.withColumnRenamed("rid", "r"), F.col("rid") == F.col("r"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    return out.select("rid", "doc_id", "base", every.alias("spans"))


def listed(spans: Column | str) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda b: F.concat_ws(":", F.get(kinds, b["k"]), b["s"].cast("string"), b["e"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, text and n_chars) with every span replaced by its kind in brackets; overlapping spans as one,
    under the first one's kind. All columns stay; n_chars is the new length. A null text stays null.

    Base spans are found again in each row as it is rewritten; only spans that patterns add are joined to it.
    """
    found = save(scan(docs), "pii-scan", docs.sparkSession)
    added = discover(found, docs).join(found.select(F.col("rid"), F.col("doc_id"), F.col("g")), "rid")
    added = added.groupBy(F.col("doc_id").alias("d"), F.col("g")).agg(F.collect_set(F.struct("s", "k", "e")).alias("added"))
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    both = whole.join(added, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    text = F.col("t")
    spans = F.array_sort(F.concat(F.transform(_base(text), _slim), F.coalesce("added", F.array().cast("array<struct<s:int,k:int,e:int>>"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(acc: Column, b: Column) -> Column:
        apart = b["s"] >= acc["at"]
        more = F.array(F.substring(text, acc["at"] + 1, b["s"] - acc["at"]), F.get(names, b["k"]))
        return F.struct(F.greatest(acc["at"], b["e"]).alias("at"), F.when(apart, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def rewritten(spans: Column) -> Column:
        done = F.aggregate(spans, start, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
        return F.when(F.size(spans) > 0, done).otherwise(text)

    out = both.select("row", _bound(spans, rewritten).alias("new"))
    return out.select(*[F.col("new").alias("text") if c == "text" else F.length("new").cast("long").alias("n_chars") if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def _slim(b: Column) -> Column:
    return F.struct(b["s"].alias("s"), b["k"].alias("k"), b["e"].alias("e"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Base counts, a digest of the base spans, and all spans of every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
