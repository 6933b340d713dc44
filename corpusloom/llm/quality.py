"""Line-first cleaning: rules drop lines, and a document that loses too much of its text goes.

Only Spark SQL expressions on each row: no shuffle, no Python on the executors.

Null texts have no words, so their documents fail. Empty tables give empty results. Rows with
the same doc_id are judged one by one. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, read
from corpusloom.llm.pii import let

#: Fixed values of the base rules and of the line rules.
MIN_WORDS, MAX_REPEAT_SHARE = 50, 50
MAX_LOST_SHARE = 0.3
SEPARATORS, MIN_NAV_ITEMS = r" [|»>·•] ", 3
#: A long line of prose has a mark that ends a sentence; a shorter one may be a heading.
SENTENCE_END, LONG_LINE_WORDS = r"[.!?…。！？:;]", 12
#: A run of marks stuck to words, or words shouted one by one.
NOISE = r"(?:[#*$%&|<>]{3}|!!)"
MAX_NOISE = 3
BOILERPLATE = (
    r"(?i)^[ \t]*(?:all rights reserved|copyright \(c\)|copyright ©|licensed under|released under|this work is licensed"
    r"|cookie policy|we use cookies|privacy policy|terms of (?:use|service)|click here|read more|sign up|log in|subscribe"
    r"|enable javascript|share (?:this|on)|skip to|back to top|home\b.{0,20}\babout)"
)


#: Each 3-word window of a flat text, one word further each time.
WINDOWS = "(?=([^ ]+ [^ ]+ [^ ]+))[^ ]+ "


def flat(text: Column) -> Column:
    """The words of a text (runs of anything but ASCII white space) with one space between.

    Nearly all texts have single spaces and line feeds only; the others take a regular expression.
    """
    plain = F.replace(text, F.lit("\n"), F.lit(" "))
    return F.trim(F.when(plain.rlike("[\\x09-\\x0D]|  "), F.regexp_replace(text, f"[{SPACE}]+", " ")).otherwise(plain))


def repeated_words(words: Column) -> Column:
    """Number of words of a flat text that lie in a 3-word window found twice or more.

    Texts without an equal pair of windows stop after a hash set. The others sort longs of a
    window's hash, high, and its place, low, in as many bits as the places need; neighbours with
    equal hashes are compared as text, and where two texts share a hash each is compared with
    all of that hash. What the repeated windows cover adds up to the number of words.
    """

    def places(grams: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        place = lambda x: x.bitwiseAND(mask).cast("int")
        high = lambda x: x.bitwiseAND(F.bitwise_not(mask))
        gram = lambda x: F.get(grams, place(x))

        def again(keys: Column) -> Column:
            def told(x: Column, k: Column) -> Column:
                beside = [F.get(keys, k - 1), F.get(keys, k + 1)]
                met = [F.coalesce(high(y) == high(x), F.lit(False)) for y in beside]
                equal = [m & (gram(y) == gram(x)) for m, y in zip(met, beside, strict=True)]
                shared = F.exists(keys, lambda y: (y != x) & (high(y) == high(x)) & (gram(y) == gram(x)))
                return F.when(equal[0] | equal[1], True).when(met[0] | met[1], shared).otherwise(False)

            return F.filter(keys, told)

        keys = F.sort_array(F.transform(grams, lambda g, i: high(F.xxhash64(g)).bitwiseOR(i.cast("long"))))
        return F.sort_array(F.transform(let(keys, again), place))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(grams: Column) -> Column:
        found = let(F.length(F.bin(F.size(grams))), lambda bits: places(grams, bits))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(found, covered)).otherwise(F.lit(0).cast("long"))

    return let(F.regexp_extract_all(words, F.lit(WINDOWS), F.lit(1)), count)


def bad_line(line: Column) -> Column:
    """Whether a line is boilerplate, or long without a mark that ends a sentence."""
    unended = ~line.rlike(SENTENCE_END) & (F.size(F.split(line, f"[{SPACE}]+")) >= LONG_LINE_WORDS)
    return unended | line.rlike(BOILERPLATE)


def noisy_line(line: Column) -> Column:
    """Whether a line is navigation or has marks stuck to its words."""
    items = F.size(F.split(line, SEPARATORS)) - 1
    noise = F.size(F.split(line, NOISE)) - 1
    return (items >= MIN_NAV_ITEMS) | (noise > MAX_NOISE)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, n_lines, n_bad_lines, chars, lost_chars, base_failed, kept, cleaned.

    cleaned is the text without its bad lines. A document is kept if the base rules pass and
    bad lines hold at most MAX_LOST_SHARE of its characters.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    read_in = docs.select("doc_id", text.alias("text"), flat(text).alias("words"), lines.alias("lines"))
    packed = F.length(F.replace("words", F.lit(" "), F.lit("")))
    symbols = F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))
    counted = read_in.select(
        "doc_id",
        "lines",
        F.when(F.col("words") == "", F.lit(0)).otherwise(F.length("words") - packed + 1).cast("long").alias("n_words"),
        packed.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        # every separator and noise mark is a symbol or one of these
        F.col("text").rlike("!!|[»·•]").alias("marked"),
    )
    noisy = F.col("marked") | (F.col("n_symbols") > 0)
    good = F.when(noisy, F.filter("lines", lambda x: ~(noisy_line(x) | bad_line(x)))).otherwise(F.filter("lines", lambda x: ~bad_line(x)))
    judged = counted.select("*", good.alias("good"))
    size = lambda c: F.length(F.array_join(c, "")).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))
    measured = judged.select("*", failed.alias("base_failed"), size("lines").alias("chars"), (size("lines") - size("good")).alias("lost_chars"))
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("lost_chars") <= MAX_LOST_SHARE * F.col("chars"))).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("good")).cast("long").alias("n_bad_lines"), "chars", "lost_chars",
        F.array_join("good", "\n").alias("cleaned"),
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, the lines' counts, and a digest of the text without its bad lines."""
    return judge(read(spark, sf_dir, "documents")).withColumn("cleaned_sha256", F.sha2("cleaned", 256)).drop("cleaned")
