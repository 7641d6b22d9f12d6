"""Personal data: base patterns, then bootstrapped contextual extraction.

Base spans are emails, IPv4 addresses, card numbers and phone numbers. They and long hexadecimal strings are the seeds of
a bootstrap over patterns, the words around a value:

* *cues*, a word with a delimiter in front of a value (``mail: ``, ``card# ``, ``token1=``); values are whole runs of
  ``A-Za-z0-9@._+/()-`` of four or more;
* *contexts*, one or two words in front of a value, the word behind it, or one word on each side (``passport no []``,
  ``[] expires``); values are base spans, and runs with a digit.

1. Every pattern and value that occur together are an edge of a graph, with seeds at confidence 1;
2. a pattern's score is the mean confidence of its distinct values (so one that also stands around ordinary values scores
   low), and a value's confidence is the noisy-or of the scores of its patterns, for some rounds;
3. patterns of a high score and enough distinct values find all their values, seen or not, as spans of kind ``id``.

Values with spaces and values in other scripts are found as base spans only.

Everything is a column expression, an aggregation, a window over the spans of one text, or a join. Matches of a pattern get
places from the pieces between them: ``split`` gives the gaps, ``regexp_extract_all`` the matches, and their lengths add up
to code point positions. The work grows with the text, however many matches it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waylens.functions import arrays
from waylens.llm.common import materialize

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns, written so that Java's engine neither backtracks through long runs nor recurses by length. Each
#: matches what the plain pattern in its comment matches and keeps: runs are taken whole from their start.
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a local part starts where its run does, or where the last match ended
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+ with 12 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word, a delimiter and a value: the cue is the first two, the value is group 2, its whole run of characters. The match
#: ends with the cue, so a value that is a label itself (``login: password=...``) is the next match's cue as well. It stays
#: a value too: nothing tells it from the secret in ``password: correcthorse # note``. No two values overlap.
CUE = r"(?<![\p{L}\p{N}_])([\p{L}_][\p{L}\p{N}_]{1,29}+[\"']?\x20?[:=#]\x20?[\"']?)(?=([A-Za-z0-9@._+/()-]{4,}+))"
#: A run with a digit, less the marks it ends with.
SLOT = r"(?<![A-Za-z0-9@._+/()-])(?=[A-Za-z@._+/()-]*+[0-9])[A-Za-z0-9@._+/()-]{3,}[A-Za-z0-9]"
#: One or two words at the end of a gap, the last of them, and a word at the beginning of a gap.
LEFT = r"(?<![\p{L}\p{N}_])((?:[\p{L}_]{1,30}+[^\p{L}\p{N}_\n]{1,3}+){1,2})\z"
LAST = r"([\p{L}_]++[^\p{L}\p{N}_\n]++)\z"
RIGHT = r"\A([^\p{L}\p{N}_\n]{1,3}+[\p{L}_]{1,30}+)(?![\p{L}\p{N}_])"
#: Characters of a gap that are looked at, and what stands for the value in a context.
NEAR, HERE = 80, "[]"
#: Characters of a block of a text that is redacted.
BLOCK = 1024
SPANS = "array<struct<s:int,e:int,v:string,p:array<string>>>"
#: Seeds besides base spans: hexadecimal strings of 16 or more with digits and letters.
HEX_SEED = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}$"


def _contexts(gaps: Column, n: Column) -> Column:
    """For each of ``n`` matches, the patterns of the words around it."""
    def around(before: Column, after: Column) -> Column:
        clean = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
        left, right = clean(F.regexp_extract(F.right(before, F.lit(NEAR)), LEFT, 1)), clean(F.regexp_extract(F.left(after, F.lit(NEAR)), RIGHT, 1))

        def patterns(x: Column) -> Column:
            left, last, right = x["left"], x["last"], x["right"]
            own = F.array(
                F.when(last != "", F.concat(last, F.lit(HERE))), F.when(left != last, F.concat(left, F.lit(HERE))), F.when(right != "", F.concat(F.lit(HERE), right)),
                F.when((last != "") & (right != ""), F.concat(last, F.lit(HERE), right)),
            )
            return F.array_compact(own)

        return arrays.let(F.struct(left.alias("left"), F.regexp_extract(left, LAST, 1).alias("last"), right.alias("right")), patterns)

    found = F.zip_with(F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), around)
    return F.when(n > 0, found).otherwise(F.array().cast("array<array<string>>"))


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and arrays of spans with their patterns ``p``: email, ip, card, phone, and candidates: cue and slot."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    patterns = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, ""), "phone": (PHONE, "+"), "cue": (CUE, ""), "slot": (SLOT, "")}
    none = F.array().cast("array<string>")
    search = lambda p, guard: F.when(F.contains("__text", F.lit(guard)), F.regexp_extract_all("__text", F.lit(p), F.lit(0))).otherwise(none)
    rows = rows.withColumns({f"__m_{k}": search(p, g) for k, (p, g) in patterns.items()})
    rows = rows.withColumn("__values", F.when(F.size("__m_cue") > 0, F.regexp_extract_all("__text", F.lit(CUE), F.lit(2))).otherwise(none))
    rows = rows.withColumns({f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("__text", p, -1)).otherwise(none) for k, (p, _) in patterns.items()})

    def placed(kind: str) -> Column:
        m, g = F.col(f"__m_{kind}"), F.col(f"__g_{kind}")
        at = arrays.spans(m, g)
        if kind == "cue":
            label = lambda x: F.array(F.regexp_replace(F.regexp_replace(F.lower(x["v"]), " ", ""), "[0-9]+", "0"))
            return F.zip_with(at, "__values", lambda x, v: F.struct(x["e"].alias("s"), (x["e"] + F.length(v)).alias("e"), v.alias("v"), label(x).alias("p")))
        return F.zip_with(at, _contexts(g, F.size(m)), lambda x, p: F.struct(x["s"], x["e"], x["v"], p.alias("p")))

    rows = rows.select("doc_id", *[F.when(F.size(f"__m_{k}") > 0, placed(k)).otherwise(F.array().cast(SPANS)).alias(f"__{k}") for k in patterns])
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    return rows.select(
        "doc_id",
        F.col("__email").alias("email"),
        F.filter("__ip", lambda x: F.forall(F.split(x["v"], r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(256)) <= 255)).alias("ip"),
        F.filter("__card", lambda x: F.call_function("luhn_check", digits(x["v"]))).alias("card"),
        F.filter("__phone", lambda x: F.length(digits(x["v"])).between(9, 15)).alias("phone"),
        F.col("__cue").alias("cue"),
        F.filter("__slot", lambda x: F.size(x["p"]) > 0).alias("slot"),
    )


def _covered(candidates: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds to candidates ``__row, is_cue, x`` (x a span) ``covered``: how many of its characters lie in base spans of the row.

    Base spans of a row are cut into pieces that don't overlap. Pieces and both ends of each candidate are then put into
    one order, and what lies in pieces before an end is a running sum: no span meets all others of its text.
    """
    by_start = Window.partitionBy("__row").orderBy("b.s", "b.e").rowsBetween(Window.unboundedPreceding, -1)
    pieces = bases.withColumn("from", F.greatest("b.s", F.coalesce(F.max("b.e").over(by_start), F.lit(0)))).where("b.e > from")
    pieces = pieces.select("__row", F.col("from").alias("at"), F.col("b.e").alias("to"))
    ends = candidates.select("__row", "is_cue", "x", F.explode(F.array("x.s", "x.e")).alias("at"))
    # at one place the ends come first: a piece that begins there lies behind them
    order = Window.partitionBy("__row").orderBy("at", F.col("to").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, last = F.coalesce(F.sum(F.col("to") - F.when(F.col("to").isNotNull(), F.col("at"))).over(order), F.lit(0)), F.coalesce(F.max("to").over(order), F.lit(0))
    both = ends.unionByName(pieces, allowMissingColumns=True).withColumn("before", size - F.greatest(F.lit(0), last - F.col("at"))).where("to IS NULL")
    return both.groupBy("__row", "is_cue", "x").agg((F.max("before") - F.min("before")).alias("covered"))


def score_patterns(edges: DataFrame, rounds: int = 3, carry: float = 0.5) -> DataFrame:
    """``pattern, score, n_values`` after ``rounds`` over the graph ``pattern, value, seed`` (one row an edge)."""
    confidence = edges.groupBy("value").agg(F.max("seed").cast("double").alias("confidence"))
    for i in range(rounds):
        scored = edges.join(confidence, "value").groupBy("pattern").agg(F.avg("confidence").alias("score"), F.count("*").alias("n_values"))
        if i < rounds - 1:
            passed = edges.join(scored.where(F.col("score") >= carry), "pattern")
            heard = passed.groupBy("value").agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("heard"))
            seeds = edges.groupBy("value").agg(F.max("seed").cast("double").alias("own"))
            confidence = seeds.join(heard, "value", "left").select("value", F.greatest(F.col("own"), F.coalesce(F.col("heard"), F.lit(0.0))).alias("confidence"))
            confidence = materialize(confidence, "pii-confidence")
    return scored


def find_personal_data(
    docs: DataFrame, min_score: float = 0.8, min_values: int = 5, min_context_values: int = 20, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id`` and the spans of every row: arrays ``email, ip, card, phone, id`` of structs (s, e, v).

    Null texts count as empty and have no spans. Repeated rows and null ids are searched row by row. Repeated values count
    once for a pattern, so copies of a text don't make one. A pattern needs ``min_score`` and ``min_values`` distinct
    values (``min_context_values`` if it has no delimiter). ``id`` spans of which base spans cover half or more are left
    out, but for hexadecimal strings that are seeds (a key has the digits of a card by chance); each is there once, values
    of any length whole. An empty table gives no rows. Other columns aren't read.
    """
    rows = base_spans(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "pii-spans")  # from here on row ids are fixed
    base = F.concat("email", "ip", "card", "phone")
    candidates = rows.where((F.size("cue") > 0) | (F.size("slot") > 0)).select("__row", (F.size(base) > 0).alias("met"), F.size("cue").alias("n_cues"), F.posexplode(F.concat("cue", "slot")).alias("i", "x"))
    candidates = candidates.select("__row", "met", (F.col("i") < F.col("n_cues")).alias("is_cue"), "x")
    bases = rows.where(((F.size("cue") > 0) | (F.size("slot") > 0)) & (F.size(base) > 0)).select("__row", F.explode(base).alias("b"))
    free = candidates.where("NOT met").select("__row", "is_cue", "x", F.lit(0).cast("long").alias("covered"))
    cues = free.unionByName(_covered(candidates.where("met").drop("met"), bases))
    secret = F.lower("x.v").rlike(HEX_SEED)
    known = (F.col("covered") > 0) & (2 * F.col("covered") >= F.col("x.e") - F.col("x.s")) & ~secret
    cues = cues.select("__row", "x.*", known.alias("known"), ((F.col("covered") > 0) | secret).alias("seed"), "is_cue")
    # a run that a base span covers is no value of its context: the base span is
    cues = materialize(cues.where("is_cue OR NOT known"), "pii-candidates")
    seen = rows.where(F.size(base) > 0).select(F.explode(base).alias("x")).select(F.explode("x.p").alias("pattern"), F.col("x.v").alias("value"), F.lit(True).alias("seed"))
    found = seen.union(cues.select(F.explode("p").alias("pattern"), F.col("v").alias("value"), "seed"))
    # in the graph a digest stands for a long value, so that its rows are narrow
    node = F.when(F.length("value") > 64, F.sha2("value", 256)).otherwise(F.col("value"))
    edges = materialize(found.groupBy("pattern", node.alias("value")).agg(F.max("seed").alias("seed")), "pii-edges")
    enough = F.when(F.contains("pattern", F.lit(HERE)), min_context_values).otherwise(min_values)
    trusted = score_patterns(edges, rounds).where((F.col("score") >= min_score) & (F.col("n_values") >= enough)).select("pattern")
    hits = cues.where("NOT known").select("__row", "s", "e", "v", F.explode("p").alias("pattern")).join(trusted, "pattern")
    ids = hits.groupBy("__row").agg(F.sort_array(F.collect_set(F.struct("s", "e", "v"))).alias("id"))
    plain = lambda k: F.transform(k, lambda x: F.struct(x["s"], x["e"], x["v"])).alias(k)
    return rows.join(ids, "__row", "left").select("doc_id", *[plain(k) for k in KINDS[:4]], F.coalesce("id", F.array().cast("array<struct<s:int,e:int,v:string>>")).alias("id"))


def marked(kinds: tuple[str, ...]) -> Column:
    """All spans of ``kinds`` as structs s, i, e, k by start, then kind as listed."""
    def tag(i: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k"))

    return F.sort_array(F.concat(*[F.transform(k, tag(i, k)) for i, k in enumerate(kinds)]))


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of ``kinds`` by start, then kind as listed, joined with commas."""
    return F.array_join(F.transform(marked(kinds), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each of the sorted ``spans`` replaced by its kind in angle brackets; what overlaps goes with the first.

    Pieces are cut from blocks of the text, so a piece doesn't count characters from the text's beginning.
    """
    def piece(blocks: Column, start: Column, end: Column) -> Column:
        i, j = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        cut = lambda k, at, n: F.coalesce(F.substring(F.get(blocks, k), at + 1, n), F.lit(""))
        across = F.concat(cut(i, start % BLOCK, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), cut(j, F.lit(0), end % BLOCK))
        return F.when(i == j, cut(i, start % BLOCK, end - start)).otherwise(across)

    def replaced(blocks: Column) -> Column:
        ends = F.transform(spans, lambda x: x["e"])
        own = F.zip_with(spans, arrays.running_max(ends, before=True), lambda x, at: F.struct(x["s"].alias("s"), x["k"].alias("k"), at.alias("at")))
        own = F.filter(own, lambda x: x["s"] >= x["at"])
        clear = F.transform(own, lambda x: F.concat(piece(blocks, x["at"], x["s"]), F.lit("<"), x["k"], F.lit(">")))
        return F.concat(F.array_join(clear, ""), piece(blocks, F.coalesce(F.array_max(ends), F.lit(0)), F.length(text)))

    return arrays.let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), replaced)
