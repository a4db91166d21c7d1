"""Personal data by bootstrapped contextual extraction, in DataFrame operations throughout.

Base rules find seed entities of four kinds; random strings that a credential's usual label
introduces are the seeds of a fifth kind, which no base rule has. Every token run that holds a
digit or an @ is a candidate: an instance (its surface) that stands in lexical patterns (the word
or label before it, in quotes or not, and the word after it). A pattern is read in two ways: with the candidate's
shape, and as a word alone, which reaches formats that no rule knows. Scores go around the graph of
patterns and instances: a pattern is as sure as the share of its occurrences that are
known instances of a kind, an instance as sure as its sure patterns together; sure
instances are known in the next round. Candidates that sure patterns vouch for become spans;
a seed of the fifth kind does so on no other ground.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
# Words that label credentials.
LABELS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "secret_key", "auth_token", "access_token")
# The contract's patterns with possessive quantifiers, which match the same here as
# nothing that follows a part can begin inside it. A look-behind (or \G, the end of the match before)
# skips starts inside a run whose first start fails alike, which keeps long runs linear.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
_SALTS = 16
_OPEN, _SHUT = "(\\[<{\"'“„«", ")\\]>}\"'”“»,;:!?."


def _pieces(text: Column, rule: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """What a rule's match must meet besides; a failing match is dropped and not tried otherwise."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(F.lit(True))
    )


def _words_beside(gap: Column) -> Column:
    """A gap's length, its first word, and its last one, with a sign of assignment that follows it. Whole words: each regex takes one pass."""
    last = F.regexp_extract(gap, r"(?<!\S)(\S++(?:\s++[=:]++>?+)?+)\s*+$", 1)
    return F.struct(F.char_length(gap).alias("n"), F.regexp_extract(gap, r"^\s*+(\S++)", 1).alias("first"), F.regexp_replace(last, r"\s++", "").alias("last"))


def _located(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of all rows, and (row, kind, start, end, match, left, right) of all matches and candidates."""
    text = F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    likely = text.rlike("[0-9@]")
    guard = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+")), "": likely}
    arrays = []
    for kind, rule in [*RULES.items(), ("", CANDIDATE)]:
        match, gaps = _pieces(text, rule)
        context = F.transform(gaps, _words_beside if not kind else lambda x: F.struct(F.char_length(x).alias("n"), F.lit("").alias("first"), F.lit("").alias("last")))
        arrays.append(F.when(guard[kind], F.struct(F.lit(kind).alias("kind"), match.alias("matches"), context.alias("gaps"))))
    found = F.when(likely, F.filter(F.array(*arrays), lambda x: x.isNotNull() & (F.size(x["matches"]) > 0)))
    table = materialize(rows.select("row", "doc_id", found.alias("found")), "pii-matches")
    each = table.select("row", F.explode("found").alias("f"))
    each = each.select("row", "f.kind", "f.matches", F.posexplode("f.gaps").alias("i", "gap"))
    each = each.select("row", "kind", "i", "gap", F.get("matches", F.col("i")).alias("match"))
    order = Window.partitionBy("row", "kind").orderBy("i")
    size = F.col("gap.n") + F.coalesce(F.char_length("match"), F.lit(0))
    end = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    each = each.select("row", "kind", "match", end.alias("end"), F.col("gap.last").alias("left"), F.lead("gap.first").over(order).alias("right")).filter("match is not null")
    spans = each.select("row", "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match", "left", "right")
    return table.select("row", "doc_id"), spans


def _shape(surface: Column) -> Column:
    """Classes of characters: long hexadecimal and mixed strings by class and length band, else letters as one a and digits as 9."""
    n = F.char_length(surface)
    plain = F.regexp_replace(F.regexp_replace(surface, r"\p{L}++", "a"), "[0-9]", "9")
    mixed = surface.rlike("[0-9]") & surface.rlike("[A-Za-z]")
    return (
        F.when(mixed & surface.rlike("^[0-9A-Fa-f]{8,}+$"), F.concat(F.lit("hex"), n.cast("string")))
        .when(mixed & surface.rlike("^[0-9A-Za-z_+/=-]{12,}+$"), F.concat(F.lit("mix"), (n - n % 4).cast("string")))
        .otherwise(plain)
    )


def _candidates(spans: DataFrame) -> DataFrame:
    """(row, start, end, surface, shape, left, right): candidates without label and outer signs; a quote that opens one stays with the word before it."""
    own = spans.filter("kind = ''")
    label = F.regexp_extract("match", r"^([A-Za-z_-]+[=:]+)[^=:\s]", 1)
    own = own.withColumn("label", label).withColumn("match", F.substring(F.col("match"), F.length("label") + 1, F.length("match")))
    # a bracket around the first digits of several, as in (017) 555-7713, belongs to the surface
    lead = F.regexp_extract("match", rf"^(?:(?!\([0-9]++\)[ /.-]?[0-9])[{_OPEN}])*+", 0)
    own = own.withColumn("lead", lead)
    own = own.withColumn("start", F.col("start") + F.length("label") + F.length("lead")).withColumn("match", F.substring(F.col("match"), F.length("lead") + 1, F.length("match")))
    quoted = F.col("lead").rlike("[\"'“„«]$")
    inside = F.regexp_extract("match", "^([^\"'”“»]++)[\"'”“»]", 1)
    surface = F.when(quoted & (inside != ""), inside).otherwise(F.regexp_replace("match", f"[{_SHUT}]++$", ""))
    own = own.withColumn("surface", surface).withColumn("end", F.col("start") + F.char_length("surface")).filter("surface <> ''")
    left = F.lower(F.when(F.length("label") > 0, F.col("label")).otherwise(F.col("left")))
    left = F.when(quoted & (left != ""), F.concat(left, F.lit('"'))).otherwise(left)
    return own.select("row", "start", "end", "surface", _shape(F.col("surface")).alias("shape"), left.alias("left"), F.lower("right").alias("right"))


def _secrets(candidates: DataFrame) -> DataFrame:
    """Seeds of the fifth kind: random strings of 16 characters or more after a credential's label."""
    words = "|".join(LABELS)
    random = F.col("shape").rlike("^(?:hex|mix)") & (F.char_length("surface") >= 16)
    return candidates.filter(random & F.col("left").rlike(f"^(?:{words})[=:]++>?+\"?+$")).select("surface").distinct().withColumn("kind", F.lit("secret"))


def _may(surface: Column, kind: str) -> Column:
    """Whether a surface could be of a kind though it has no format of the kind's rule: a coarse type only."""
    digits = F.length(F.regexp_replace(surface, "[^0-9]", ""))
    like = {
        "email": surface.rlike(r"^[^\s@,;:/<>()]++@[^\s@,;:/<>()]++$"),
        "ip": surface.rlike(r"^[0-9A-Fa-fx]*+(?:[^\s0-9A-Za-z@]++[0-9A-Fa-f]*+){2,}+$"),
        "card": digits.between(7, 19),
        "phone": digits.between(7, 15),
        "secret": surface.rlike(r"^\S{8,}+$") & surface.rlike("[0-9]") & surface.rlike(r"\p{L}"),
    }[kind]
    refused = surface.rlike(f"^(?:{RULES[kind]})$") if kind in RULES else F.lit(False)
    return like & ~refused & (F.lit(kind in ("email", "secret")) | ~F.contains(surface, F.lit("@")))


def _by_word(edges: DataFrame, known: DataFrame, sure: float, support: int, unknown: float) -> DataFrame:
    """(word, kind, p) of sure words. Known instances of other kinds, surfaces that cannot be of the kind and those that its
    rule refused count against it; unknown surfaces that could be count for a share `unknown`."""
    n, own = F.col("n"), F.coalesce("kind", F.lit(""))
    sums = []
    for i, k in enumerate(ALL):
        hit, may = own == k, (own == "") & (F.col("may").bitwiseAND(1 << i) > 0)
        mass = F.sum(F.when(hit, n * F.col("confidence")).otherwise(0.0))
        against = F.sum(F.when(hit, 0.0).when(may, n * unknown).otherwise(n))
        sums.append(F.struct(F.lit(k).alias("kind"), mass.alias("mass"), against.alias("against"), F.count(F.when(hit, 1)).alias("seen")))
    each = edges.join(known, "surface", "left").groupBy("word").agg(F.array(*sums).alias("s")).select("word", F.explode("s").alias("s"))
    p = F.col("s.mass") / (F.col("s.mass") + F.col("s.against"))
    return each.filter(F.col("s.seen") >= support).select("word", "s.kind", p.alias("p")).filter(F.col("p") >= sure)


def _equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows."""
    rows = a.withColumn("_of", F.lit(1)).unionByName(b.withColumn("_of", F.lit(-1)))
    return rows.groupBy(*a.columns).agg(F.sum("_of").alias("_of")).filter("_of <> 0").isEmpty()


def bootstrap(candidates: DataFrame, base: DataFrame, rounds: int = 3, sure: float = 0.8, support: int = 3, unknown: float = 0.1) -> DataFrame:
    """(surface, kind, confidence) of instances that are no base seeds but that sure patterns vouch for after some rounds.

    A pattern counts where `support` distinct known instances or more stand in it. What only a word
    speaks for needs its shape's evidence too: the shape's surfaces must stand in sure words at
    least a quarter as often as the kind's known instances do, else confidence falls in proportion.
    """
    rules = candidates.join(base.select("row", "start", "end", "kind"), ["row", "start", "end"]).groupBy("surface").agg(F.min("kind").alias("kind"))
    rules = materialize(rules, "pii-seeds")
    seeds = rules.unionByName(_secrets(candidates).join(rules, "surface", "left_anti")).withColumn("confidence", F.lit(1.0))
    known = seeds = materialize(seeds, "pii-known")
    sides = F.explode(F.array(F.concat(F.lit("<"), "left"), F.concat(F.lit(">"), "right")))
    edges = candidates.select("surface", "shape", sides.alias("word")).filter("length(word) > 1")
    edges = edges.groupBy("word", "shape", "surface").agg(F.count(F.lit(1)).alias("n"))
    may = sum((F.when(_may(F.col("surface"), k), 1 << i).otherwise(0) for i, k in enumerate(ALL)), F.lit(0))
    edges = materialize(edges.withColumn("may", may).withColumn("salt", F.pmod(F.hash("surface"), F.lit(_SALTS))), "pii-edges")
    totals = edges.groupBy("word", "shape").agg(F.sum("n").alias("total"))
    shapes = edges.select("shape", "surface").distinct().groupBy("shape").agg(F.count(F.lit(1)).alias("all"))
    doubt = F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999))))
    bit = sum((F.when(F.col("kind") == k, 1 << i).otherwise(0) for i, k in enumerate(ALL)), F.lit(0))
    for _ in range(rounds):
        held = edges.join(known, "surface").groupBy("word", "shape", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("mass"), F.count(F.lit(1)).alias("seen"))
        patterns = held.filter(F.col("seen") >= support).join(totals, ["word", "shape"]).withColumn("p", F.col("mass") / F.col("total")).filter(F.col("p") >= sure)
        scored = edges.join(patterns.select("word", "shape", "kind", "p"), ["word", "shape"]).groupBy("surface", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
        words = _by_word(edges, known, sure, support, unknown).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        inside = edges.join(words, ["word", "salt"]).groupBy("surface", "shape", "may", "kind").agg((1 - F.exp(doubt)).alias("confidence"))
        inside = materialize(inside, "pii-inside")
        own = known.groupBy("kind").agg(F.count(F.lit(1)).alias("known"))
        share = inside.join(known.select("surface", "kind"), ["surface", "kind"]).groupBy("kind").agg(F.count(F.lit(1)).alias("in")).join(own, "kind")
        share = share.select("kind", (F.col("in") / F.col("known")).alias("share"))
        fits = inside.groupBy("shape", "kind").agg(F.count(F.lit(1)).alias("in")).join(shapes, "shape").join(F.broadcast(share), "kind")
        fits = fits.select("shape", "kind", F.least(F.lit(1.0), 4 * F.col("in") / F.col("all") / F.col("share")).alias("fit"))
        wide = inside.filter(F.col("may").bitwiseAND(bit) > 0).join(fits, ["shape", "kind"])
        wide = wide.select("surface", "kind", (F.col("confidence") * F.col("fit")).alias("confidence"))
        scored = scored.unionByName(wide)
        best = scored.filter(F.col("confidence") >= sure).groupBy("surface").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("surface", "b.kind", "b.confidence")
        best = materialize(best, "pii-best")
        before, known = known, materialize(seeds.unionByName(best.join(seeds, "surface", "left_anti")), "pii-known")
        if _equal(before, known):  # further rounds would give the same
            break
    return best.join(rules, "surface", "left_anti")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, base, spans), one row for each row of docs: arrays of (start, rank, end, kind) in order.

    Offsets are code points, ends exclusive. base holds the rules' spans, spans those and
    what bootstrapping adds where no base span overlaps, or where it holds one of its kind that cuts a word in
    two (an e-mail with a letter that the rule doesn't take). Null and empty texts have none.
    Equal rows get equal results; rows are told apart by place, not by doc_id.
    """
    rows, located = _located(docs)
    located = materialize(located, "pii-spans")
    base = located.filter("kind <> ''").filter(_holds(F.col("kind"), F.col("match")))
    candidates = _candidates(located)
    fresh = candidates.join(bootstrap(candidates, base, **options), "surface").select("row", "start", "end", "kind", "surface")
    overlap = base.select(F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("kind").alias("_kind"))
    inside = (F.col("_kind") == F.col("kind")) & (F.col("_start") >= F.col("start")) & (F.col("_end") <= F.col("end"))
    ends = F.concat(F.when(F.col("_start") > F.col("start"), F.substring("surface", F.col("_start") - F.col("start"), F.lit(1))).otherwise(""), F.substring("surface", F.col("_end") - F.col("start") + 1, F.lit(1)))
    cut = inside & ends.rlike(r"[\p{L}\p{M}\p{N}]")
    fresh = fresh.join(overlap, (F.col("row") == F.col("_row")) & (F.col("start") < F.col("_end")) & (F.col("end") > F.col("_start")) & ~cut, "left_anti").drop("surface")
    rank = F.array_position(F.array(*map(F.lit, ALL)), F.col("kind"))
    both = base.select("row", "kind", "start", "end", F.lit(True).alias("rule")).unionByName(fresh.withColumn("rule", F.lit(False)))
    both = both.withColumn("s", F.struct("start", rank.alias("rank"), "end", "kind"))
    per = both.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("rule"), F.col("s")))).alias("base"), F.array_sort(F.collect_set("s")).alias("spans"))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:bigint,end:bigint,kind:string>>)")
    return rows.join(per, "row", "left").select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Per document counts and a digest of the base spans, all spans as text, and how many those are."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))

