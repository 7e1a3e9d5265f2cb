"""Secret scan with character Markov models, in native expressions only.

Long tokens are compared under two first-order character models, one of random strings
and one of ordinary identifiers.  A token whose mean log-likelihood ratio per transition
exceeds a threshold is taken for a secret.  Three fixed patterns (assignments, access keys, hex runs)
are found besides.  Positions are code points; the scan is one pass without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import table, text_of

# The three patterns, their kinds in order, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

#: Characters the models know; tokens are runs of at least TOKEN_LEAST of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
TOKEN_LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}" % TOKEN_LEAST
#: Mean log-likelihood ratio per transition, in nats, above which a token is a secret.
RATIO = 0.5
#: The models are trained on at most so many documents (those with the smallest id hash), on their whole texts.
SAMPLE_DOCUMENTS = 500
#: Share of a row's probability that is spread by the kinds of characters instead of the counted transitions.
SMOOTHING = 0.15

# Words of program text, labelled as ordinary; they stand beside the words of the texts.
PROGRAM_WORDS = (
    "account active admin agent allow answer append archive assert attribute balance batch begin block boolean bridge bucket "
    "buffer button callback change character class close code command common config constant content control copy count current "
    "custom database debug define deploy device directory display domain drive element enable engine environment event exception "
    "export factory field filter flag font forward framework generate graph guest hash height history host image include input "
    "install integer item job journal jump kernel keyboard knowledge language layout level license link local log loop main map "
    "max menu method mode module mouse multi network node notification number offset option output package parameter parse pattern "
    "pixel plugin policy position preview product project proxy python queue quiet range record refresh release remove replace "
    "request reset response return right root row run save schema screen search select sequence service setting shell size source "
    "sql start static stop store string submit switch table task test theme time toggle tool trace transaction trigger unique "
    "unknown upload usage utility value vector version view void warning weight widget window word wrapper xml yellow zone"
).split()


STEP = 100


def let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def spans(text: Column, pattern: str, kind: int, keep) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches that ``keep(all, group 2)`` accepts.

    A match begins after the pieces and matches before it.  Sums run in blocks of STEP matches, so
    a text with very many matches costs little more than one with few.
    """
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if "(" in pattern.replace("(?i)", "") else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), second.alias("g"), F.split(text, pattern, -1).alias("p"))

    def located(parts: Column) -> Column:
        lengths = F.transform(parts, lambda x: (F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long"))

        def numbered(own: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / STEP).cast("int")), lambda b: _sum(F.slice(own, b * STEP + 1, STEP)))

            def placed(sums: Column) -> Column:
                heads = F.transform(sums, lambda _, b: _sum(F.slice(sums, F.lit(1), b)))

                def ready(head: Column) -> Column:
                    def one(x: Column, i: Column) -> Column:
                        block = F.floor(i / STEP).cast("int")
                        before = F.get(head, block) + _sum(F.slice(own, block * STEP + 1, i - block * STEP))
                        start = before + F.length(x["p"])
                        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["m"])).alias("end"), keep(x["m"], x["g"]).alias("keep"))

                    return F.filter(F.transform(parts, one), lambda s: s["end"].isNotNull() & s["keep"])

                return let(heads, ready)

            return let(blocks, placed)

        return let(lengths, numbered)

    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,keep:boolean>>")
    return F.when(text.rlike(pattern), let(zipped, located)).otherwise(empty)


def code(char: Column) -> Column:
    """Number of a character in the alphabet."""
    return F.instr(F.lit(ALPHABET), char) - 1


def training_samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """Labelled samples (token, random, weight) from a bounded sample of documents.

    Ordinary ones are the words of the texts and of program text, and identifiers, constants, file names, paths, numbers, dates and
    rules made of them.  Random strings are digests of the texts, written as hex, base64, upper-case and mixed letters and digits.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(documents)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_of().alias("text")).join(F.broadcast(chosen.distinct()), "_id")
    cut = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9+/_-])[A-Za-z]{2,40}(?![A-Za-z0-9+/_-])"), F.lit(0))
    program = spark.range(1).select(F.split(F.lit(" ".join(PROGRAM_WORDS)), " ").alias("w"), F.lit(" ".join(PROGRAM_WORDS)).alias("text"))
    # Program words in other orders, so that they count beside any number of texts.
    mixed = program.select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"), "w", "text").select(
        F.array_sort("w", lambda a, b: F.when(F.xxhash64(a, "k") < F.xxhash64(b, "k"), -1).otherwise(1)).alias("w"), F.concat("text", F.col("k").cast("string")).alias("text")
    )
    lines = texts.select(cut.alias("w"), "text").unionByName(mixed)
    digits = F.regexp_replace(F.sha2("text", 256), "[a-f]", "")
    part = lambda i, n: F.substring(digits, i, n)

    def joined(i: Column) -> Column:
        """Four words from the i-th on, in one of eight ways in turn."""
        own = F.slice("w", i + 1, 4)
        low, named, upper = (F.transform(own, f) for f in (F.lower, F.initcap, F.upper))
        pascal = F.array_join(named, "")
        camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, F.lit(2), F.length(pascal)))
        ways = [F.array_join(low, "_"), F.array_join(low, "-"), F.array_join(low, "/"), camel, pascal, F.array_join(upper, "_"), F.concat(F.array_join(low, "_"), part(3, 2)), F.concat(F.lit("/"), F.array_join(low, "/"))]
        return F.get(F.array(*ways), ((i / 4) % len(ways)).cast("int"))

    dates = [F.concat(F.lit("20"), part(k, 2), F.lit(by + "0"), part(k + 2, 1), F.lit(by + "1"), part(k + 3, 1), F.lit(end)) for k in (1, 5, 9) for by, end in (("-", ""), ("-", "-"), ("_", ""), ("/", "/"))]
    numbers = [digits, F.reverse(digits), F.concat(part(1, 6), F.lit("_"), part(7, 6)), F.concat(part(3, 8), F.lit("-"), part(5, 8))]
    rules = [F.lit(c * n) for c in "-_/+" for n in (20, 40)]
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(4)), joined)
    ordinary = F.concat(F.transform("w", F.lower), groups, F.array(*dates, *numbers, *rules))
    digests = [F.sha2(F.concat("text", F.lit(i)), 256) for i in range(8)]
    base64 = [F.regexp_replace(F.base64(F.unhex(d)), "=", "") for d in digests]
    dashed = [F.regexp_replace(F.substring(d, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5") for d in digests[:4]]
    random = F.array(
        *digests[:2],
        F.upper(digests[2]),
        *dashed,
        *base64,
        *[F.translate(b, "+/", "-_") for b in base64],
        *[F.regexp_replace(b, "[+/]", "") for b in base64],
        *[F.upper(b) for b in base64[:3]],
    )
    made = [lines.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("weight")).withColumn("random", F.lit(k)) for k, own in enumerate((ordinary, random))]
    return made[0].unionByName(made[1])


def kind_of(char: str) -> str:
    return "lower" if char.islower() else "upper" if char.isupper() else "digit" if char.isdigit() else "mark"


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, row by row of the alphabet.

    Transitions are counted by Spark; a table of the size of the alphabet squared comes back.  SMOOTHING of each row's weight goes to
    what its kind of character is followed by (lower case, upper case, digit or mark), so that a transition no sample has is as likely as
    its kinds make it.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))
    counted = samples.filter(F.length("token") >= 2).select("random", "weight", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.sum("weight").alias("n")).collect()
    size = len(ALPHABET)
    totals = [{}, {}]
    for row in counted:
        a, b = (ALPHABET.find(c) for c in row["pair"])
        if a >= 0 and b >= 0:
            totals[row["random"]][a, b] = totals[row["random"]].get((a, b), 0) + row["n"]
    kinds = [kind_of(c) for c in ALPHABET]
    members = {k: kinds.count(k) for k in kinds}
    logs = []
    for own in totals:
        rows, moves, after = [0.0] * size, {}, {}
        for (a, b), n in own.items():
            rows[a] += n
            moves[kinds[a], kinds[b]] = moves.get((kinds[a], kinds[b]), 0) + n
            after[kinds[a]] = after.get(kinds[a], 0) + n

        def likely(a: int, b: int) -> float:
            by_kind = (moves.get((kinds[a], kinds[b]), 0) + 1) / (after.get(kinds[a], 0) + 4) / members[kinds[b]]
            return (1 - SMOOTHING) * own.get((a, b), 0) / rows[a] + SMOOTHING * by_kind if rows[a] else by_kind

        logs.append([math.log(likely(a, b)) for a in range(size) for b in range(size)])
    return [round(x - y, 4) for y, x in zip(*logs)]


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions; positive where random is likelier."""
    codes = F.transform(F.sequence(F.lit(1), F.length(token)), lambda i: code(F.substring(token, i, F.lit(1))))

    def mean(own: Column) -> Column:
        steps = F.sequence(F.lit(1), F.size(own) - 1)
        total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.get(model, F.get(own, i - 1) * len(ALPHABET) + F.get(own, i)))
        return total / (F.size(own) - 1)

    return let(codes, mean)


def _written(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of all spans by start, then kind as in KINDS; ``base_sha256`` is
    the digest of the same list without the kind ``random``, which the models add.
    Null text counts as empty; a null doc_id stays null (and is not trained on); repeated rows get
    a row each; an empty table gives no rows; other columns are ignored.
    """
    model = model or train(training_samples(docs))
    literal = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    text = F.col("text")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = plain.select(
        "doc_id",
        spans(text, ASSIGN, 0, lambda m, g: F.length(g) >= ASSIGN_LEAST).alias("assign"),
        # Runs are maximal, so their least length may as well stand in the pattern.
        spans(text, ACCESS.replace("+", "{%d,}" % (ACCESS_LEAST - 4)), 1, lambda m, g: F.lit(True)).alias("access"),
        spans(text, HEX.replace("+", "{%d,}" % HEX_LEAST), 2, lambda m, g: F.lit(True)).alias("hex"),
        spans(text, TOKEN, 3, lambda m, g: ratio(m, literal) > RATIO).alias("random"),
    )
    counted = found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.array_sort(F.concat("assign", "access", "hex")).alias("base"),
        F.array_sort(F.concat("assign", "access", "hex", "random")).alias("all"),
    )
    return counted.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("all")).alias("spans"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
