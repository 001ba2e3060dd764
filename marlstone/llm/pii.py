"""Personal data and secrets by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Beside them looser patterns
propose candidates: phone numbers without a plus, addresses spelled with 'at' and 'dot', 13 to 15 digit cards,
names after a title, and secrets (a value given to a token, key or password, or one of a known form). On each candidate that
meets no base span, four labellers vote yes (1), no (0) or abstain (-1):

    shape      the usual form of its kind
    gazetteer  a word of the kind's list just before it (for names and secrets: or in it)
    context    it stands alone: a mark, bracket or line end before it, white space or a mark after it (secrets: no word touches it)
    counter    looks like a date, an amount, a version or a placeholder (no), else abstains

Expectation-maximisation over the counts of vote patterns estimates the labellers' accuracies and each pattern's
posterior; a logistic span classifier over kind, votes and length class is then fitted to the posteriors and
accepts candidates above one half. Only counts of (kind, votes, length class) reach the driver, at most
5 x 2 x 2 x 2 x 2 x 4 rows; if there are no candidates, none is accepted. DataFrame expressions only.

Spans are in code points, end exclusive. Patterns are written so that no text makes them backtrack for long or
recurse (possessive repeats; a match can only begin at a run's beginning or where the last one ended). Places come
from the lengths of matches and of what is between them, added up in two layers of blocks, and what stands before and after a
match from what is between: so time grows with the text and the matches, not with their product. Whether a candidate meets
a base span is found by sorting the spans of each row, as rows of their own.

Nulls: a null text is empty; a null doc_id stays null. Each row gives a row, repeated or not; other columns aren't
read. An empty table gives no rows. Ties at one half aren't accepted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import blank_null, materialize, table

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns; see the module's text for what is added.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign that a text without which no match can be there.
SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = ["email", "ip", "card", "phone", "name", "secret"]
_SECRET = "api[_-]?key|secret|token|passw(?:or)?d|pwd|access[_-]?key|auth[_-]?key|private[_-]?key"
_TITLE = "Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?"
LOOSE = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{{1,64}}+ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{{1,63}}+ ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{{2,12}}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.)-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-][0-9]{2,4}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4})?(?!\.?[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?: \p{{Lu}}\p{{Ll}}{{1,30}}+)?",
    "secret": rf"(?<![A-Za-z0-9])(?:(?i:(?:[A-Za-z0-9]{{1,20}}[_-]){{0,3}}(?:{_SECRET}))[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?[A-Za-z0-9+/_.=-]{{8,200}}+[\"']?|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,80}}+|sk-[A-Za-z0-9_-]{{20,80}}+|xox[abprs]-[A-Za-z0-9-]{{10,80}}+|-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----)",
}
#: What a text must contain for the looser pattern to be tried.
HINT = {"email": r"(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63} ?(?:\[dot\]|\(dot\)| dot )", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"[0-9]\)?[ ./-][0-9]{2}", "name": rf"(?:{_TITLE})\.? \p{{Lu}}", "secret": rf"(?i:{_SECRET})[ \t]{{0,3}}[:=]|AKIA[0-9A-Z]|gh[pousr]_|sk-|xox[abprs]-|-----BEGIN"}
GAZETTEER = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|address",
    "card": "card|visa|credit|debit|kreditkarte|carte|tarjeta|account",
    "phone": "phone|tel|call|fax|mobile|cell|dial|telefon|handy|tél|teléfono|móvil",
    "name": "dear|name|from|sincerely|signed|by|contact|lieber|liebe|cher|chère|estimad",
    "secret": _SECRET,
}
SHAPE = {
    "email": r"^\S+ ?(?:\[at\]|\(at\)| at ) ?\S+ ?(?:\[dot\]|\(dot\)| dot ) ?(?:com|org|net|edu|gov|de|fr|es|uk|eu|io|info)$",
    "card": r"^[0-9]{13,15}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$|^[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,3}$",
    "phone": r"^\([0-9]{2,5}\)[ ./-][0-9]{3,4}[ .-]?[0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$|^0[0-9]{2,4}[ /-][0-9]{4,8}$",
    "name": r"^\S+ \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
    "secret": r"[0-9a-fA-F]{24,}[\"']?$|^(?:AKIA|gh[pousr]_|sk-|xox|-----)|(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}[\"']?$",
}
COUNTER = {
    "email": r"^$",
    "card": r"^(?:19|20)[0-9]{2}[ -](?:0[1-9]|1[0-2])[ -]",
    "phone": r"^(?:19|20)[0-9]{2}[ ./-](?:0?[1-9]|1[0-2])[ ./-]|^[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)|^[0-9]{1,3} [0-9]{3}(?: [0-9]{3})?$",
    "name": r"^$",
    "secret": r"(?i)example|change.?me|placeholder|your[_-]|x{6}|\*{4}|0{8}|none|null|true|false|undefined",
}
_BLOCK = 64
#: Code points before a match that labellers read.
_BEFORE = 30


def _once(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _sums_before(lengths: Column) -> Column:
    """For each length the sum of those before it, by sums of blocks and of blocks of blocks."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    block = lambda i: F.floor(i / _BLOCK).cast("int")

    def blocks(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), block(F.size(a))), lambda b: total(F.slice(a, b * _BLOCK + 1, _BLOCK)))

    def inside(a: Column, upper: Column) -> Column:
        return F.transform(a, lambda _, i: F.get(upper, block(i)) + total(F.slice(a, block(i) * _BLOCK + 1, i % _BLOCK)))

    def two(b: Column) -> Column:
        top = lambda bb: _once(F.transform(bb, lambda _, j: total(F.slice(bb, F.lit(1), j))), lambda t: _once(inside(b, t), lambda m: inside(lengths, m)))
        return _once(blocks(b), top)

    return _once(blocks(lengths), two)


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """array of (at, to, what) of all matches, at from 0; with around also what is just before and after."""

    def place(found: Column) -> Column:
        def build(gaps: Column) -> Column:
            def structs(before: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    at = F.get(before, i) + F.length(F.get(gaps, i))
                    near = [F.right(F.concat(F.coalesce(F.get(gaps, i - 1), F.lit("")), F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(_BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("after")]
                    return F.struct(at.alias("at"), (at + F.length(m)).alias("to"), m.alias("what"), *(near if around else []))

                return F.transform(found, one)

            steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
            return _once(steps, lambda s: _once(_sums_before(s), structs))

        none = F.array().cast("array<struct<at:int,to:int,what:string" + (",before:string,after:string>>" if around else ">>"))
        return F.when(F.size(found) > 0, _once(F.split(text, pattern, -1), build)).otherwise(none)

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)


def _valid(kind: str, what: Column) -> Column:
    digits = F.regexp_replace(what, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(what, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _validator(kind: str):
    return lambda m: _valid(kind, m["what"])


def base_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<at:int,to:int,what:string>>")
    out = {}
    for kind, pattern in BASE.items():
        may = F.contains(text, F.lit(SIGN[kind])) if SIGN[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
        out[kind] = F.when(may, F.filter(located(text, pattern), _validator(kind))).otherwise(none)
    return out


def _features(kind: str):
    def of(m: Column) -> Column:
        what, before, after = m["what"], m["before"], m["after"]
        near = F.lower(F.concat(before, what) if kind in ("name", "secret") else before).rlike(GAZETTEER[kind])
        alone = (~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]")) if kind == "secret" else (before.rlike(r"(?:^|[:=(\[\"\n]\s?)$") & after.rlike(r"^(?:$|[\s.,;)\]\"])"))
        digits = F.length(F.regexp_replace(what, "[^0-9]", ""))
        return F.struct(
            F.lit(kind).alias("kind"), m["at"].alias("at"), m["to"].alias("to"), what.rlike(SHAPE[kind]).cast("int").alias("shape"), F.when(near, 1).otherwise(-1).alias("gazetteer"), alone.cast("int").alias("context"),
            F.when(what.rlike(COUNTER[kind]), 0).otherwise(-1).alias("counter"), F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 12, 2).otherwise(3).alias("size"),
        )

    return of


def candidates(text: Column) -> Column:
    """array of (kind, at, to, shape, gazetteer, context, counter, size)."""
    none = F.array().cast("array<struct<kind:string,at:int,to:int,shape:int,gazetteer:int,context:int,counter:int,size:int>>")
    parts = []
    for kind, pattern in LOOSE.items():
        free = located(text, pattern, around=True)
        digits = lambda m: F.regexp_replace(m["what"], "[^0-9]", "")
        fits = F.filter(free, lambda m: F.length(digits(m)).between(8, 15)) if kind == "phone" else F.filter(free, lambda m: F.call_function("luhn_check", digits(m))) if kind == "card" else free
        parts.append(F.when(text.rlike(HINT[kind]), F.transform(fits, _features(kind))).otherwise(none))
    return F.concat(*parts)


def _clear(found: DataFrame) -> DataFrame:
    """(row, c): candidates that meet no base span; found: row, the kinds of BASE and more."""
    spans = lambda kind: F.transform(kind, lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to")))
    some = found.where(F.size("more") > 0)
    base = some.select("row", F.explode(F.concat(*[spans(k) for k in BASE])).alias("s")).select("row", "s.at", "s.to", F.lit(None).cast("struct<" + found.schema["more"].dataType.elementType.simpleString().removeprefix("struct<")).alias("c"))
    own = some.select("row", F.explode("more").alias("c")).select("row", "c.at", "c.to", "c")
    earlier, later = W.partitionBy("row").orderBy("at"), W.partitionBy("row").orderBy(F.desc("at"))
    ends = F.max(F.when(F.col("c").isNull(), F.col("to"))).over(earlier)  # of base spans that begin at the same place or before
    next_ = F.min(F.when(F.col("c").isNull(), F.col("at"))).over(later)  # and the first that begins there or later
    return base.union(own).select("row", "c", "at", "to", ends.alias("ends"), next_.alias("next")).where("c is not null and coalesce(ends, 0) <= at and (next is null or next >= to)").select("row", "c")


VOTES = ["shape", "gazetteer", "context", "counter"]


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[list[tuple[float, float]], float, dict[tuple[int, ...], float]]:
    """Of (votes, count) patterns: each labeller's (rate of yes if true, rate of yes if false) among its votes,
    the share that is true, and each pattern's posterior. Starts from the majority; counts are smoothed."""
    n = len(patterns[0][0]) if patterns else 0
    post = {}
    for votes, _ in patterns:
        cast = [v for v in votes if v >= 0]
        post[votes] = (sum(cast) + 0.5) / (len(cast) + 1)
    rates, prior = [(0.7, 0.3)] * n, 0.5
    for _ in range(rounds):
        total = sum(c for _, c in patterns)
        prior = (sum(c * post[v] for v, c in patterns) + 1) / (total + 2)
        rates = []
        for k in range(n):
            voted = [(v, c) for v, c in patterns if v[k] >= 0]
            yes = [sum(c * w(post[v]) * v[k] for v, c in voted) for w in (lambda p: p, lambda p: 1 - p)]
            every = [sum(c * w(post[v]) for v, c in voted) for w in (lambda p: p, lambda p: 1 - p)]
            rates.append(((yes[0] + 2) / (every[0] + 3), (yes[1] + 1) / (every[1] + 3)))
        for votes, _ in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (t, f) in zip(votes, rates, strict=True):
                odds += 0 if v < 0 else math.log(t / f) if v else math.log((1 - t) / (1 - f))
            post[votes] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return rates, prior, post


def features(kind: str, votes: tuple[int, ...], size: int) -> list[str]:
    return ["bias", f"kind={kind}", *(f"{n}={v}" for n, v in zip(VOTES, votes, strict=True)), f"size={size}"]


def fit(rows: list[tuple[str, tuple[int, ...], int, float]], rounds: int = 400, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier from (kind, votes, size, count)."""
    merged: dict[tuple[int, ...], float] = {}
    for _, votes, _, count in rows:
        merged[votes] = merged.get(votes, 0) + count
    _, _, post = expectation_maximisation(sorted(merged.items()))
    weights: dict[str, float] = {}
    total = sum(r[3] for r in rows)
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for kind, votes, size, count in rows:
            names = features(kind, votes, size)
            p = 1 / (1 + math.exp(-sum(weights.get(x, 0.0) for x in names)))
            for x in names:
                slope[x] = slope.get(x, 0.0) + count * (post[votes] - p)
        for x, g in slope.items():
            weights[x] = weights.get(x, 0.0) * (1 - ridge) + rate * g / total
    return weights


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_secret, n_spans."""
    text = blank_null()
    base = docs.select("doc_id", text.alias("text")).select("doc_id", "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])
    bare = [F.transform(k, lambda m: F.struct(m["at"].alias("at"), m["to"].alias("to"))).alias(k) for k in BASE]
    found = materialize(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", *bare, candidates(F.col("text")).alias("more")))
    clear = materialize(_clear(found))
    patterns = clear.groupBy("c.kind", *[f"c.{v}" for v in VOTES], "c.size").agg(F.count(F.lit(1)).alias("n")).collect()
    weights = fit([(r.kind, tuple(r[v] for v in VOTES), r["size"], float(r.n)) for r in sorted(patterns)])
    total = F.lit(weights.get("bias", -1.0))
    for name, w in sorted(weights.items()):
        if name != "bias":
            field, value = name.split("=")
            total = total + F.when(F.col(f"c.{field}").cast("string") == value, w).otherwise(0.0)
    rank = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind")).cast("int") - 1).alias("rank")
    added = clear.where(total > 0).groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct(rank, F.col("c.at").alias("at"), F.col("c.to").alias("to"))).alias("added"))
    item = lambda kind: lambda m: F.struct(F.lit(KINDS.index(kind)).alias("rank"), m["at"].alias("at"), m["to"].alias("to"))
    basic = F.concat(*[F.transform(k, item(k)) for k in BASE])
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, KINDS)), s["rank"]), s["at"].cast("string"), s["to"].cast("string"))), ",")
    done = found.join(added, F.col("row") == F.col("r"), "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<rank:int,at:int,to:int>>"))).withColumn("basic", basic)
    secrets = F.size(F.filter("added", lambda s: s["rank"] == KINDS.index("secret")))
    return done.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.encode(written(F.col("basic")), "UTF-8"), 256).alias("base_sha256"), written(F.array_sort(F.concat("basic", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"), secrets.cast("long").alias("n_secret"), (F.size("basic") + F.size("added")).cast("long").alias("n_spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
