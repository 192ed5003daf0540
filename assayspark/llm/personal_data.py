"""Personal data: base patterns and bootstrapped contextual extraction, as DataFrame expressions.

Base entities (e-mail, IP address, card, phone) are found by patterns; they are seeds, and so are secrets whose shape
speaks for itself (``SECRET``: long hexadecimal runs of letters and digits).  A lexical pattern is what stands before a
value: a word with an assignment (``key = "``, ``name:``), or else the word alone.  Its score is the share of all its
occurrences in the corpus that stand before a known instance; an instance is a token that
looks like an identifier (a run of letters, digits, ``_`` or ``-``, at least ``MIN_TOKEN`` long and with a digit).
In each round, patterns with a high score make the instances behind them known, and those raise the score of
further patterns.  Identifiers behind a high-scoring pattern are added as spans of kind ``id``.
The pattern-instance graph stays in Spark; both sides are scored by grouped counts.

Regular expressions are written so that no group repeats over the text and no run is scanned from each of its places:
separators inside a number and dots inside a host are first marked by one private character each, which keeps
all offsets.

Positions count code points, the end is exclusive.  Null and empty texts have no spans; repeated rows get equal spans;
other columns are kept, those with the names of the results are replaced.  A tie cannot arise: scores are compared with limits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, text_column

KINDS = ("email", "ip", "card", "phone")
#: Shortest identifier.
MIN_TOKEN = 6
#: A pattern needs this share of its occurrences, and this many distinct known instances.
MIN_PRECISION, MIN_INSTANCES = 0.6, 3
#: Rounds of scoring.
ROUNDS = 3
#: Characters before an entity that are searched for its pattern.  A word that does not lie in them whole is no pattern.
REACH = 32
#: Seeds besides the base entities.
SECRET = r"^(?=[^a-f]*[a-f])(?=[^0-9]*[0-9])[0-9a-f]{32,}$"
_ASSIGNED = r"\p{L}++\s*+[=:]\s*+[\"']?"

_SEP, _DOT = "\ue000", "\ue001"
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
_PATTERNS = {
    # \G: a match may begin in the middle of a run only where the last one has ended
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9][0-9{_SEP}]{{12,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{%d,}+" % MIN_TOKEN,
}
_SPANS = "array<struct<start:long,end:long,value:string>>"


def _positions(value: Column, pattern: str) -> Column:
    """All matches as (start, end, value): their lengths and those of the gaps between them, added up."""
    found, gaps = F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), F.split(value, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(found, gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    return F.aggregate(pairs, zero, step)["spans"]


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        def part(p: Column) -> Column:
            plain = F.ltrim(p, F.lit("0"))
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(value, r"\."), part)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _spans(value: Column, kind: str) -> Column:
    marked = F.translate(value, _SEP + _DOT, "??")
    if kind == "email":
        marked = F.regexp_replace(marked, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
        present = F.contains(value, F.lit("@"))
    elif kind == "card":
        marked = F.regexp_replace(marked, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP)
        present = value.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")
    elif kind == "ip":
        present = value.rlike(r"[0-9]\.[0-9]")
    elif kind == "phone":
        present = F.contains(value, F.lit("+"))
    else:
        present = value.rlike("[0-9]")
    found = F.filter(_positions(marked, _PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(present, found).otherwise(F.array().cast(_SPANS))


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with an array of (start, end, value) per base kind, in columns named after the kinds."""
    df = df.withColumn("_text", text_column(df, text))
    return df.withColumns({kind: _spans(F.col("_text"), kind) for kind in KINDS}).drop("_text")


def listed(kind: str, spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _keyed(docs: DataFrame) -> DataFrame:
    out = docs.select(F.col("doc_id"), text_column(docs).alias("_text"))
    return out.withColumn("_hash", F.xxhash64("_text"))


def entity_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, email, ip, card, phone): the base spans of every row, once computed and stored,
    with ``seen``: entities and identifiers and the words before them."""
    found = _keyed(docs).withColumns({kind: _spans(F.col("_text"), kind) for kind in (*KINDS, "id")})
    # an identifier that lies in an entity is part of it
    inside = lambda s: F.exists(F.concat(*[F.col(k) for k in KINDS]), lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))
    found = found.withColumn("id", F.filter("id", lambda s: ~inside(s)))

    def context(kind: str) -> Column:
        def one(s: Column) -> Column:
            before = F.substring(F.col("_text"), F.greatest(s["start"] - REACH, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(REACH)).cast("int"))
            before = F.lower(before)
            found_before = F.regexp_extract(before, rf"((?<!\p{{L}}){_ASSIGNED}|\p{{L}}+[^\p{{L}}]*)$", 1)
            whole = (F.length(found_before) < F.length(before)) | (s["start"] <= REACH)
            assigned = found_before.rlike(rf"^{_ASSIGNED}$")
            pattern = F.when(assigned, F.regexp_replace(found_before, r"\s+", "")).otherwise(F.regexp_extract(found_before, r"^\p{L}+", 0))
            shape = F.when(s["value"].rlike(SECRET), "secret").otherwise(kind) if kind == "id" else F.lit(kind)
            return F.struct(shape.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                            F.when(whole, pattern).otherwise("").alias("word"))

        return F.transform(F.col(kind), one)

    return found.withColumn("seen", F.concat(*[context(k) for k in (*KINDS, "id")])).drop("_text", "id")


def bootstrap(seen: DataFrame, words: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns whose score is high after ``rounds`` rounds: (word, precision).

    ``seen``: kind, value and pattern (``word``) of seeds (kind other than ``id``) and identifiers; ``words``: word, n,
    the occurrences of each pattern in the corpus."""
    seen = seen.where("word <> ''").groupBy("word", "value", (F.col("kind") != "id").alias("seed")).agg(F.count("*").alias("n"))
    total = words.join(seen.select("word").distinct(), "word", "left_semi").select("word", F.col("n").alias("total"))
    edges = staged(seen.join(total, "word"), "edges")
    known = edges.where("seed").select("value").distinct()
    trusted = None
    for _ in range(rounds):
        score = (
            edges.join(known, "value", "left_semi")
            .groupBy("word")
            .agg(F.sum("n").alias("hits"), F.count_distinct("value").alias("instances"), F.max("total").alias("total"))
            .withColumn("precision", F.least(F.col("hits") / F.col("total"), F.lit(1.0)))
        )
        trusted = staged(
            score.where((F.col("precision") >= MIN_PRECISION) & (F.col("instances") >= MIN_INSTANCES)).select("word", "precision"),
            "patterns",
        )
        known = edges.join(trusted, "word", "left_semi").select("value").unionByName(edges.where("seed").select("value")).distinct()
    return trusted


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): occurrences of each possible pattern in all texts, lower-cased: runs of letters, and those with an assignment."""
    text = F.lower(text_column(docs))
    words = F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")
    assigned = F.regexp_extract_all(text, F.lit(rf"(?<!\p{{L}}){_ASSIGNED}"), F.lit(0))
    assigned = F.when(text.rlike("[=:]"), F.transform(assigned, lambda a: F.regexp_replace(a, r"\s+", ""))).otherwise(F.array().cast("array<string>"))
    return docs.select(F.explode(F.concat(words, assigned)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, _hash, email, ip, card, phone, id): all spans of each row; _hash is xxhash64 of its text."""
    found = staged(entity_spans(docs), "entities")
    seen = found.select("doc_id", "_hash", F.explode("seen").alias("s")).select("doc_id", "_hash", "s.*")
    trusted = bootstrap(seen.select("kind", "value", "word"), word_counts(docs))
    span = F.struct("start", "end", "value")
    new = seen.where("kind IN ('id', 'secret')").join(trusted, "word", "left_semi").select("doc_id", "_hash", span.alias("s")).distinct()
    new = new.groupBy(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_h")).agg(F.array_sort(F.collect_list("s")).alias("id"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h"))
    out = found.drop("seen").join(new, same, "left").drop("_doc", "_h")
    return out.withColumn("id", F.coalesce("id", F.array().cast(_SPANS)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    base = F.array_join(F.concat(*[listed(k, F.col(k)) for k in KINDS]), ",")
    every = F.array_join(F.concat(*[listed(k, F.col(k)) for k in (*KINDS, "id")]), ",")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        every.alias("spans"),
    )


def _masked(value: Column) -> Column:
    """Every span replaced by its kind; of spans that overlap, the first names the mask."""
    spans = F.array_sort(F.col("_spans"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(value, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        mask = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        more = F.when(s["start"] >= state["at"], F.concat(state["out"], gap, mask)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], F.substring(value, (done["at"] + 1).cast("int"), F.length(value)))


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans in ``text`` replaced by [EMAIL], [IP], [CARD], [PHONE] or [ID]; n_chars follows."""
    found = find_personal_data(docs)

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    tagged = [named(k) for k in (*KINDS, "id")]
    spans = found.select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_h"), F.concat(*tagged).alias("_spans"))
    spans = spans.where(F.size("_spans") > 0).dropDuplicates(["_doc", "_h"])
    # the row is kept as a struct, so that no name of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(text_column(docs)).alias("_hash"))
    out = rows.join(spans, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_h")), "left")
    hit, text = F.col("_spans").isNotNull(), F.col("row.text")
    masked = F.when(hit, _masked(text)).otherwise(text)
    new = {"text": masked}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(masked).cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
