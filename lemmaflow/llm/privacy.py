"""Personal data, and the words that give it away.

Addresses and numbers are found by patterns; each is an entity, protected by removal. Around every
occurrence lies a window of words. Over the corpus, an entity's share of all words is the size of its
windows, which says how much information its identity is (in bits), and a word's pointwise mutual
information with those windows says how much of it the word reveals. Words that reveal more than a
set share, with enough evidence from different contexts, are generalised to their first letters where the class of all
words that begin alike reveals less, and removed where it does not; that holds for each of their occurrences.

All of it is DataFrame functions. Positions follow from splitting a text by a pattern and from its
matches; windows are as many as there are entities in the texts; each document's words meet the
revealing ones by a join, before which a fixed-size bitmap drops nearly all that are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaflow.llm.common import back, durable, rest_of, row_key

#: Kinds in their order, with patterns. They match what the plain patterns of the contract match: runs that cannot end
#: otherwise are possessive, and a match does not begin inside a run that failed, so that scans take linear time.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Between words, which are runs of digits, letters a to z and all characters beyond ASCII; and one such character.
BETWEEN, LETTER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: Bits of the bitmap of words.
BITS = 1 << 18

SPAN = "array<struct<kind:string,start:int,end:int,value:string,words:array<string>>>"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), BETWEEN), "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _value(kind: str, match: Column) -> Column:
    """What a match stands for, the same however it is written; null where it fails."""
    if kind == "email":
        return _lower(match)
    if kind == "ip":
        return F.when(match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), match)
    digits = F.regexp_replace(match, "[^0-9]", "")
    low, high = (13, 19) if kind == "card" else (9, 15)
    fits = F.length(digits).between(low, high)
    return F.when(fits & luhn(digits) if kind == "card" else fits, digits)


def _context(left: Column, right: Column, window: int) -> Column:
    """The words next to a match, `window` on either side at most, other personal data left out. They are
    sought among the 15 * window nearest characters; a word that is cut there is none."""
    reach = 15 * window
    masked = lambda text: words_of(F.regexp_replace(text, "|".join(KINDS.values()), " "))
    near_left = F.when(F.length(left) > reach, F.regexp_replace(F.right(left, F.lit(reach)), f"^(?i:{LETTER})+", "")).otherwise(left)
    near_right = F.when(F.length(right) > reach, F.regexp_replace(F.left(right, F.lit(reach)), f"(?i:{LETTER})+$", "")).otherwise(right)
    before = masked(near_left)
    return F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - window + 1), F.lit(window)), F.slice(masked(near_right), 1, window))


def spans_of(text: Column, kind: str, window: int) -> Column:
    """The kind's matches in a text, in order: (kind, start, end, value, words), places by code point, end
    exclusive, words the context."""
    pattern = F.lit(KINDS[kind])
    mark = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    gaps, matches = F.split(text, KINDS[kind], -1), F.regexp_extract_all(text, pattern, F.lit(0))

    def built(pair: Column) -> Column:
        sized = F.transform(pair["matches"], lambda m, i: F.struct(F.length(F.get(pair["gaps"], i)).alias("gap"), F.length(m).alias("size"), _value(kind, m).alias("value"), i.alias("i")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,i:int>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + x["gap"]
            one = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["value"].alias("value"), x["i"].alias("i"))
            return F.struct((at + x["size"]).alias("at"), F.when(x["value"].isNotNull(), F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"))

        placed = F.aggregate(sized, start, step, lambda s: s["out"])
        return F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _context(F.get(pair["gaps"], x["i"]), F.get(pair["gaps"], x["i"] + 1), window).alias("words")))

    found = F.flatten(F.transform(F.array(F.struct(gaps.alias("gaps"), matches.alias("matches"))), built))  # bound once
    some = F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9]")
    return F.when(some, found).otherwise(F.array()).cast(SPAN)


def base_spans(docs: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key_id, key_text, n_words, email, ip, card, phone: arrays of spans), one row for every row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = [spans_of(text, kind, window).alias(kind) for kind in KINDS]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *row_key(f"`{id_col}`", f"`{text_col}`"), F.size(words_of(text)).cast("long").alias("n_words"), *kinds)


def bitmap(words: DataFrame, bits: int = BITS) -> list[int]:
    """A bit for each hash of a word: bits / 64 numbers, whatever the number of words."""
    h = F.pmod(F.xxhash64("word"), F.lit(bits))
    held = words.groupBy(F.shiftright(h, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))).alias("m"))
    out = [0] * (bits // 64)
    for r in held.collect():
        out[r["at"]] = r["m"]
    return out


def in_bitmap(word: Column, held: list[int]) -> Column:
    """Whether the word's bit is set; true for every word that the bitmap was made of."""
    h = F.pmod(F.xxhash64(word), F.lit(64 * len(held)))
    numbers = F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")  # a constant to the optimizer
    return F.getbit(F.get(numbers, F.shiftright(h, 6).cast("int")), F.pmod(h, F.lit(64)).cast("int")) == 1


def revealing_words(docs: DataFrame, found: DataFrame, share: float = 0.95, contexts: int = 3, bits: float = 20.0, letters: int = 3, text_col: str = "text") -> DataFrame:
    """(word, removed, share): the words that reveal an entity, whether they are to be removed or generalised to their
    first `letters` characters, and the greatest share of an entity's information that they reveal.

    found: base_spans of docs. With T words in all, an entity whose windows hold c words carries
    log2(T / c) bits. A word with n of its m occurrences in those windows reveals log2(n * T / (m * c)). It is
    too revealing where that is `share` of the entity's bits or more, if n times its bits make `bits`
    or more, and at least `contexts` different windows have it: copies of a text are one context.
    """
    seen = durable(found.select(F.explode(F.concat(*KINDS)).alias("s")).select(F.concat_ws(":", "s.kind", "s.value").alias("entity"), "s.words", F.xxhash64("s.words").alias("context")))
    near = seen.select("entity", "context", F.explode("words").alias("word"))
    covers = near.groupBy("entity").agg(F.count("*").alias("c"))
    tallied = near.groupBy("entity", "word", "context").agg(F.count("*").alias("n")).groupBy("entity", "word").agg(F.sum("n").alias("n"), F.count("*").alias("contexts"))
    tallied = durable(tallied.withColumn("prefix", F.left("word", F.lit(letters))))
    maybe = tallied.where(F.col("contexts") >= contexts)

    held = bitmap(maybe.select("word").distinct())
    every = docs.select(F.explode(words_of(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("word"))
    counted = durable(every.groupBy(F.left("word", F.lit(letters)).alias("prefix"), F.when(in_bitmap(F.col("word"), held), F.col("word")).alias("word")).agg(F.count("*").alias("m")))
    total = (found.agg(F.sum("n_words")).first()[0]) or 0

    def revealed(n: str, m: str) -> Column:
        """The share of an entity's bits."""
        own, whole = F.least(F.col(n) / F.col(m), F.lit(1.0)), F.log2(F.lit(float(total)) / F.col("c"))
        return F.when(whole > 0, (F.log2(own) + whole) / whole).otherwise(0.0)

    entities = maybe.join(covers, "entity")
    strong = entities.join(counted.where("word is not null").drop("prefix"), "word").withColumn("revealed", revealed("n", "m"))
    strong = strong.where((F.col("revealed") >= share) & (F.col("n") * F.col("revealed") * F.log2(F.lit(float(total)) / F.col("c")) >= bits))
    classes = tallied.groupBy("entity", "prefix").agg(F.sum("n").alias("prefix_n"))
    sizes = counted.groupBy("prefix").agg(F.sum("m").alias("prefix_m"))
    judged = strong.join(classes, ["entity", "prefix"]).join(sizes, "prefix")
    removed = (F.length("word") <= letters) | (revealed("prefix_n", "prefix_m") >= share)
    return durable(judged.groupBy("word").agg(F.max(removed).alias("removed"), F.max("revealed").alias("share")))


def private_spans(docs: DataFrame, window: int = 8, share: float = 0.95, contexts: int = 3, bits: float = 20.0, letters: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key_id, key_text, email, ip, card, phone, generalised, removed), one row for every row of docs: arrays of
    (kind, start, end, value) by start, places in code points, end exclusive.

    Base kinds are those of KINDS, without matches that fail their checks. generalised and removed are the
    occurrences of revealing_words that meet no base span; value is what stands in for the
    word, its first letters and "*" or nothing. Null text counts as empty; rows with the same id and text get the same
    answer; no rows give no rows.
    """
    found = durable(base_spans(docs, window, id_col, text_col))
    words = revealing_words(docs, found, share, contexts, bits, letters, text_col)

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(*row_key(f"`{id_col}`", f"`{text_col}`"), text.alias("t"))
    own = keyed.select("key_id", "key_text", F.explode(F.array_distinct(words_of(F.col("t")))).alias("word"))
    hits = own.where(in_bitmap(F.col("word"), bitmap(words))).join(words.select("word", "removed"), "word")
    lists = durable(hits.groupBy("key_id", "key_text").agg(*[F.array_sort(F.collect_set(F.when(c, F.col("word")))).alias(f"{n}_words") for n, c in (("generalised", ~F.col("removed")), ("removed", F.col("removed")))]))  # a document's own words

    placed = keyed.join(lists, ["key_id", "key_text"]).select("key_id", "key_text", *[_word_spans(F.col("t"), F.col(f"{n}_words"), n, letters).alias(n) for n in ("generalised", "removed")]).dropDuplicates(["key_id", "key_text"])
    plain = "array<struct<kind:string,start:int,end:int,value:string>>"
    rows = found.join(placed, ["key_id", "key_text"], "left")
    base = {kind: F.transform(kind, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).cast(plain) for kind in KINDS}

    def apart(name: str) -> Column:
        taken = F.concat(*KINDS)
        free = F.filter(name, lambda w: ~F.exists(taken, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
        return F.coalesce(free, F.array().cast(plain)).alias(name)

    return rows.select("doc_id", "key_id", "key_text", *[c.alias(k) for k, c in base.items()], apart("generalised"), apart("removed"))


def _word_spans(text: Column, words: Column, kind: str, letters: int) -> Column:
    """Where any of the words stands in a text, as spans."""
    pattern = F.concat(F.lit(f"(?<!{LETTER})(?:"), F.array_join(words, "|"), F.lit(f")(?!{LETTER})"))  # words hold no signs
    lower = _lower(text)

    def built(pair: Column) -> Column:
        sized = F.transform(pair["matches"], lambda m, i: F.struct(F.length(F.get(pair["gaps"], i)).alias("gap"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            at = s["at"] + x["gap"]
            value = F.concat(F.left(x["m"], F.lit(letters)), F.lit("*")) if kind == "generalised" else F.lit("")
            one = F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(x["m"])).alias("end"), value.alias("value"))
            return F.struct((at + F.length(x["m"])).alias("at"), F.array_append(s["out"], one).alias("out"))

        return F.aggregate(sized, start, step, lambda s: s["out"])

    parts = F.array(F.struct(F.split(lower, pattern, -1).alias("gaps"), F.regexp_extract_all(lower, pattern, F.lit(0)).alias("matches")))
    return F.when(F.size(words) > 0, F.flatten(F.transform(parts, built))).otherwise(F.array())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def privacy_report(docs: DataFrame, **settings) -> DataFrame:
    """Digest of private_spans, whose settings it takes: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of
    kind:start:end of the base spans, by kind and start, joined by commas), spans (all spans, joined likewise)."""
    found = private_spans(docs, **settings)
    base, more = F.concat(*KINDS), F.concat(*KINDS, "generalised", "removed")
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(more).alias("spans"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with its text sanitised: [email], [ip], [card] or [phone] for personal data, the first letters and "*" for
    words that are generalised, [word] for words that are removed. Where spans overlap, the first one's
    mark stands for all that they cover. Null texts stay null; all other columns come back as they are."""
    found = private_spans(docs, id_col=id_col, text_col=text_col, **settings).drop("doc_id").dropDuplicates(["key_id", "key_text"])
    keyed = docs.select(rest_of(docs), *row_key(f"`{id_col}`", f"`{text_col}`"), F.col(f"`{text_col}`").alias("t"))
    mark = lambda s: F.when(s["kind"] == "generalised", s["value"]).when(s["kind"] == "removed", "[word]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
    spans = F.array_sort(F.transform(F.concat(*KINDS, "generalised", "removed"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), mark(s).alias("mark"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        kept = F.col("t").substr(s["at"] + 1, x["start"] - s["at"])
        more = F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(kept, x["mark"]))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), more.alias("out"))

    whole = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.col("t").substr(s["at"] + 1, F.length("t"))))
    return keyed.join(found, ["key_id", "key_text"]).withColumn("_whole", whole).select(*back(docs, **{text_col: F.col("_whole")}))
