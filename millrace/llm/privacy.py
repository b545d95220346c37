"""Personal data: fixed patterns, and contextual patterns bootstrapped from what they find (operator 3).

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import salted, stored, text_hash, texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
# The kinds' patterns, written so that a match is only tried where one can begin and no run is read twice: long
# texts of one character class take linear time, and no repeated group is deep. They match what the plain forms
#   [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   [0-9]([\x20-]?[0-9])+ with 13 to 19 digits             \+[0-9][\x20().0-9-]+[0-9]
# match, leftmost and without overlaps.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G(?!^)){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?:[0-9][\x20-]?){12,18}[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A token with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
# What marks a credential, the fifth kind (fixed values): public forms of keys, and names a value is given under.
SECRET = "secret"
KEY_FORMS = r"^(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|sk[-_][0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]+\.eyJ[0-9A-Za-z_.-]+)$"
KEY_NAMES = r"(?:^|[^a-z])(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"']? ?(?:=|:|:=|=>)$"
MARKS = "\"')>],.;:!?#*%$&|"


NO_SPANS = "array<struct<kind:string,start:int,end:int,found:string>>"
BLOCK = 512


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), F.lit(1))


def before(sizes: Column) -> Column:
    """Sums of the elements before each element. In blocks: growing one array element by element would copy it each time."""

    def run(values: Column, first: Column) -> Column:
        start = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def whole(blocks: Column) -> Column:
        firsts = run(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), firsts.alias("f")), lambda x: run(x["b"], x["f"])))

    numbers = lambda s: F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int"))
    return let(sizes, lambda s: let(F.transform(numbers(s), lambda k: F.slice(s, k * BLOCK + 1, BLOCK)), whole))


def matches(text: Column, pattern: str) -> Column:
    """Of each match of the pattern: s (where it starts, in code points), g (the text since the match before), f (the match),
    n (the text up to the next match) and h (the next match)."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))

    def one(x: Column) -> Column:
        return F.struct((x["b"] + F.char_length(x["z"]["g"])).alias("s"), x["z"]["g"].alias("g"), x["z"]["f"].alias("f"), x["z"]["n"].alias("n"), x["z"]["h"].alias("h"))

    def placed(z: Column) -> Column:
        sizes = F.transform(z, lambda x: F.char_length(x["g"]) + F.char_length(x["f"]))
        return F.transform(F.arrays_zip(z.alias("z"), before(sizes).alias("b")), one)

    def some(m: Column) -> Column:
        n = F.size(m["f"])
        after = F.concat(F.slice(m["f"], 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit("")))
        return let(F.arrays_zip(F.slice(m["g"], 1, n).alias("g"), m["f"].alias("f"), F.slice(m["g"], 2, n).alias("n"), after.alias("h")), placed)

    return let(both, lambda m: F.when(F.size(m["f"]) > 0, some(m)).otherwise(F.array().cast("array<struct<s:int,g:string,f:string,n:string,h:string>>")))


def spans(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, found) of the pattern's matches, in code points."""
    return F.transform(matches(text, pattern), lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.char_length(x["f"])).alias("end"), x["f"].alias("found")))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits(found)), ""), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def holds(kind: str, found: Column) -> Column:
    """What a match must satisfy besides its pattern."""
    if kind == "ip":
        return found.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return luhn(found)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def holding(kind: str):
    return lambda x: holds(kind, x["found"])


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> Column:
    """All base spans, by kind and then by start."""
    need = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    parts = []
    for kind in KINDS:
        own = F.filter(spans(text, PATTERNS[kind], kind), holding(kind))
        parts.append(F.when(need.get(kind, text.rlike("[0-9]")), own).otherwise(F.array().cast(NO_SPANS)))
    return F.concat(*parts)


def seed_kind(value: Column, two: Column, ahead: Column) -> Column:
    """The kind of the base span that a token holds, or begins (a phone number may have blanks: `ahead` is the token and
    what follows); secret for the public forms of keys, and for a value of 8 or more under a name that marks one."""
    out = F.when(value.rlike(PATTERNS["email"]), "email").when(ahead.rlike(r"^\+[0-9][0-9().-]*+(?: \(?[0-9][0-9().-]*+)*$") & F.length(digits(ahead)).between(9, 15), "phone")
    whole = {"ip": r"^[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++$", "card": r"^[0-9](?:-?[0-9]){12,18}$"}
    for kind, pattern in whole.items():
        out = out.when(value.rlike(pattern) & holds(kind, value), kind)
    return out.when(value.rlike(KEY_FORMS) | (two.rlike(KEY_NAMES) & (F.char_length(value) >= 8) & value.rlike("[0-9]")), SECRET)


def shape(value: Column) -> Column:
    """What values of one make have in common: class and length of a run of letters and digits, else letters by runs and digits one by one."""
    size = F.char_length(value).cast("string")
    out = F.when(value.rlike("^[0-9]+$"), F.concat(F.lit("d"), size)).when(value.rlike("^[0-9a-fA-F]+$"), F.concat(F.lit("h"), size)).when(value.rlike("^[0-9A-Z]+$"), F.concat(F.lit("u"), size))
    return out.when(value.rlike("^[0-9A-Za-z]+$"), F.concat(F.lit("w"), size)).otherwise(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), r"\p{L}+", "a"))


def contexts(text: Column) -> Column:
    """Identifier-like tokens (with a digit or an at sign): start, end, value, kind if it is a seed, and patterns.

    A token like name=value or name:value is the value with name= for a word before it; quotes at its front and
    marks at its end aren't part of the value. Its patterns: the word before it, the two words before it, the words
    before and after it, and, of a value of 6 or more, its shape. Words are what blanks separate, of any length.
    """
    blank = lambda c: F.translate(c, "\n\t\r", "   ")
    nines = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "9")

    # In steps, each a struct of what the next names often: an expression is computed anew wherever it stands.
    def parted(x: Column) -> Column:
        lead = F.regexp_extract(x["m"]["f"], r"^([^=:0-9@]*+[=:])?+[\"'(<\[]*+", 0)
        return F.struct(*(x["m"][c].alias(c) for c in "sfnh"), F.rtrim(blank(x["m"]["g"])).alias("gap"), F.ltrim(blank(x["m"]["n"])).alias("past"), nines(x["l"]).alias("l"), lead.alias("lead"))

    def worded(x: Column) -> Column:
        value = F.rtrim(F.substring(x["f"], F.char_length(x["lead"]) + 1, F.char_length(x["f"])), F.lit(MARKS))
        last = F.when(x["gap"] == "", x["l"]).otherwise(F.lower(F.substring_index(x["gap"], " ", -1)))
        both = F.when(F.instr(x["gap"], " ") > 0, F.lower(F.substring_index(x["gap"], " ", -2))).otherwise(F.concat_ws(" ", x["l"], F.lower(x["gap"])))
        right = F.when(x["past"] == "", nines(x["h"])).otherwise(F.lower(F.substring_index(x["past"], " ", 1)))
        name = F.lower(F.regexp_extract(x["lead"], r"^[^=:]*[=:]", 0))
        return F.struct((x["s"] + F.char_length(x["lead"])).alias("start"), value.alias("value"), name.alias("name"), last.alias("last"), both.alias("both"), right.alias("right"), F.when(x["n"] == " ", F.rtrim(x["h"], F.lit(MARKS))).alias("next"))

    def one(x: Column) -> Column:
        near = F.when(x["name"] != "", x["name"]).otherwise(x["last"])
        two = F.when(x["name"] != "", F.concat_ws(" ", x["last"], x["name"])).otherwise(x["both"])
        kind = seed_kind(x["value"], F.when(x["name"] != "", x["name"]).otherwise(x["both"]), F.concat_ws(" ", x["value"], x["next"]))
        words = F.when(near != "", F.array(F.concat(F.lit("1 "), near), F.concat(F.lit("2 "), two), F.concat(F.lit("b "), near, F.lit(" _ "), x["right"]))).otherwise(F.array().cast("array<string>"))
        own = F.when(F.char_length(x["value"]) >= 6, F.array(F.concat(F.lit("s "), shape(x["value"])))).otherwise(F.array().cast("array<string>"))
        return F.struct(x["start"].alias("start"), (x["start"] + F.char_length(x["value"])).alias("end"), F.lower(x["value"]).alias("value"), kind.alias("kind"), F.concat(words, own).alias("patterns"))

    def whole(m: Column) -> Column:
        last = F.concat(F.array(F.lit("")), F.transform(F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), lambda x: x["f"]))
        steps = F.transform(F.transform(F.arrays_zip(m.alias("m"), F.slice(last, 1, F.size(m)).alias("l")), parted), worded)
        return F.transform(F.filter(steps, lambda x: x["value"] != ""), one)

    return let(matches(text, TOKEN), whole)


def bootstrapped(seen: DataFrame, rounds: int = 4, sure: float = 0.8, seeds: int = 5) -> DataFrame:
    """key, kind, start, end of what high-confidence patterns find among the tokens of documents (key, tokens), and of the
    secrets among the seeds.

    Nodes are patterns (words around a slot, or a value's shape; see contexts) and instances (the token's value). A
    token that holds a base span or a secret is a seed of its kind with score 1. In each round a pattern's score for
    a kind is the mean score of its instances, smoothed by two instances of score 0, and an instance takes the best
    score of its patterns that reach one half. A pattern counts in a round if at least `seeds` of its instances had a
    score of `sure` in the round before (seeds always have), and is sure with a score of `sure` in the last round.
    Ends when a round moves no pattern's score by more than 0.01, after `rounds` at most. All tables are aggregates over
    (pattern, instance), never pairs of instances; a hot pattern's or instance's rows are dealt to several tasks.
    """
    tokens = seen.select("key", F.explode("tokens").alias("t")).select("key", "t", F.col("t.kind").alias("kind"), F.col("t.value").alias("value"))
    each = tokens.withColumn("pattern", F.explode(F.array_distinct("t.patterns")))
    edges = stored(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "contexts")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeded = stored(edges.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score")), "seeds")
    scores, before = seeded, None
    for k in range(rounds):
        sums = salted(edges.drop("kind"), scores, ["value"], "pattern").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.sum((F.col("score") >= sure).cast("int")).alias("known"))
        enough = sums.groupBy("pattern").agg(F.sum("known").alias("known")).where(F.col("known") >= seeds).select("pattern")
        patterns = stored(sums.drop("known").join(enough, "pattern").join(size, "pattern").select("pattern", "kind", (F.col("score") / (F.col("n") + 2)).alias("score")), f"patterns{k}")
        if before is not None:
            both = patterns.join(before.withColumnRenamed("score", "was"), ["pattern", "kind"], "left")
            if (both.agg(F.max(F.abs(F.col("score") - F.coalesce("was", F.lit(0.0))))).first()[0] or 0) <= 0.01:
                break
        before = patterns
        reached = salted(edges.drop("kind"), patterns.where("score >= 0.5"), ["pattern"], "value").groupBy("value", "kind").agg(F.max("score").alias("score"))
        scores = reached.union(seeded).groupBy("value", "kind").agg(F.max("score").alias("score"))
    good = patterns.where(F.col("score") >= sure).groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("found"))
    new = salted(each.where("kind is null"), good, ["pattern"], "key").select("key", "t", "found")
    new = new.union(tokens.where(F.col("kind") == SECRET).select("key", "t", F.col("kind").alias("found")))
    return new.groupBy("key", F.col("t.start").alias("start"), F.col("t.end").alias("end")).agg(F.min("found").alias("kind")).select("key", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base: kind, start, end, found) and added (kind, start, end; none overlaps a base span) of every row.

    Positions are code points, the end exclusive. A null text is empty. Rows that repeat or share a doc_id keep a
    row each; a null doc_id is treated like any other. An empty table gives no rows. Other columns are left out.
    """
    rows = texts(docs)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(text_hash()))  # rows alike in id and text share it, and all spans
    seen = rows.select("doc_id", key.alias("key"), base_spans(F.col("text")).alias("spans"), F.when(F.col("text").rlike("[0-9@]"), contexts(F.col("text"))).alias("tokens"))
    seen = stored(seen, "personal")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    per = bootstrapped(seen).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    clear = F.filter("added", lambda x: ~F.exists("spans", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])))
    return seen.select("doc_id", "key", "spans").join(per, "key", "left").select("doc_id", "spans", F.when(F.col("added").isNotNull(), clear).otherwise(none).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, by kind as KINDS lists them (secret last), then by start."""
    bare = F.transform("spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    both = F.concat(*(F.array_sort(F.filter(F.concat(bare, F.col("added")), of_kind(kind))) for kind in (*KINDS, SECRET)))
    counts = [F.size(F.filter("spans", of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(both).alias("spans"))
