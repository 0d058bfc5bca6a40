"""Secret scan (DataFrame functions only): patterns find candidates, a random forest removes the false ones.

The forest judges a candidate by its length, its changes between kinds of characters,
how much of it dictionary words cover, signs of a path, and the words around it. It is
trained from labelled findings.
"""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Candidates: private keys in armour; signed web tokens; what is assigned to a secret's name, from 8 characters on; and
#: unbroken runs of the characters that keys, digests and tokens are written in, from 16 on.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,24}PRIVATE KEY-----"
    r"|(?<![A-Za-z0-9_\-.])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"""|(?<=[:=\s"'])(?=[^\s"'`<>,;()\[\]{}]{8})(?<=(?i:passw|passwd|password|passphrase|pwd|secret|token|api_key|access_key)["']?\s{0,2}[:=]\s{0,2}["']?)"""
    r"""[^\s"'`<>,;()\[\]{}]{7,}[A-Za-z0-9+/=_\-!@#$%^&*]"""
    r"|(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
#: Characters of text kept on either side of a candidate.
AROUND = 48
MARK = "\x01"
#: Words in the dictionary: so many of the most frequent words of the corpus, of 4 to 12 letters.
DICTIONARY = 400

# What stands before a secret, before a digest, and how known keys begin.
SECRET_NEAR = r"(?i)(token|secret|passw|passwd|pwd|api.?key|access.?key|auth|credential|bearer|private)[^\n]{0,16}$"
DIGEST_NEAR = r"(?i)(commit|sha-?\d*|md5|checksum|digest|etag|uuid|guid|revision|build|hash|blob)[^\n]{0,16}$"
ASSIGNED = r"""[:=]\s{0,2}["']?$"""
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|sk_live_|sk_test_|xox[abp]-|AIza|glpat-)"

FEATURES = (
    "n", "digits", "uppers", "lowers", "signs", "changes", "digit_letter", "case_changes", "vowel_turns", "words", "slashes", "path_before", "path_after",
    "secret_near", "digest_near", "assigned", "quoted", "known", "hex_only", "dashes",
)


def dictionary(docs: DataFrame, size: int = DICTIONARY, text_col: str = "text") -> list[str]:
    """The words that most documents hold, counted over all of them; of equal counts the first in order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"\b[a-z]{4,12}\b"), 0))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(size).collect()]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, start, found, before, after for every candidate; start counts characters from 0.

    Texts are marked around each candidate and split at the marks, so that repeated
    candidates keep their own place; the mark, where a text holds it, is read as a blank.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.replace(F.col(text_col), F.lit(MARK), F.lit(" ")).alias("t")).where(F.col("t").rlike(CANDIDATE))
    parts = F.split(F.regexp_replace("t", f"({CANDIDATE})", f"{MARK}$1{MARK}"), MARK)
    near = F.transform(
        F.sequence(F.lit(1), (F.size("p") / 2).cast("int")),
        lambda i: F.struct(
            F.char_length(F.get("p", 2 * i - 2)).alias("gap"), F.get("p", 2 * i - 1).alias("found"),
            F.right(F.get("p", 2 * i - 2), F.lit(AROUND)).alias("before"), F.left(F.get("p", 2 * i), F.lit(AROUND)).alias("after")),
    )
    each = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("p", parts).select("id", "row", F.posexplode(near).alias("i", "c")).select("id", "row", "i", "c.*")
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("start", F.sum(F.col("gap") + F.char_length("found")).over(so_far) - F.char_length("found")).select("id", "start", "found", "before", "after")


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    covered = "|".join(sorted(words, key=len, reverse=True)) or "(?!)"
    n = F.char_length("found").cast("double")
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("found", "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    turn = F.regexp_replace(F.regexp_replace(F.lower("found"), "[^a-z]", ""), "[aeiouy]+|[^aeiouy]+", "x")
    share = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    return found.withColumn("kinds", kind).withColumns({
        "n": n,
        "digits": share(F.col("kinds"), "0"), "uppers": share(F.col("kinds"), "A"), "lowers": share(F.col("kinds"), "a"), "signs": share(F.col("kinds"), "-"),
        "changes": F.char_length(F.regexp_replace("kinds", "a+|A+|0+|-+", "x")) / n,
        "digit_letter": share(F.col("kinds"), "0(?=[aA])|[aA](?=0)"),
        "case_changes": share(F.col("kinds"), "a(?=A)|A(?=a)"),
        "vowel_turns": F.char_length(turn) / n,
        "words": 1 - F.char_length(F.regexp_replace(F.lower("found"), covered, "")) / n,
        "slashes": share(F.col("found"), "/"),
        "path_before": flag(F.col("before").rlike(r"(://|[/.@#?&])[^\s]*$")),
        "path_after": flag(F.col("after").rlike(r"^[/.@#?&:]\w")),
        "secret_near": flag(F.col("before").rlike(SECRET_NEAR)), "digest_near": flag(F.col("before").rlike(DIGEST_NEAR)),
        "assigned": flag(F.col("before").rlike(ASSIGNED)), "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "known": flag(F.col("found").rlike(KNOWN)), "hex_only": flag(F.col("found").rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "dashes": share(F.col("found"), "[-_]"),
    })


def labelled_findings(spark: SparkSession, words: list[str], each: int = 60, seed: int = 5) -> DataFrame:
    """A generated table of labelled findings (text, label), one finding a text: ``each`` texts of every shape below.

    Texts and false findings are made of dictionary ``words`` and of syllables. Findings
    labelled by hand may take its place or be added. Another seed gives a held-out part.
    """
    r = random.Random(seed)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexes = lower.upper(), digits + "abcdef"
    syllables = ["the", "er", "in", "on", "tion", "ing", "and", "re", "es", "cion", "eaux", "lich", "keit", "ung", "que", "ment", "sch", "ra", "do", "le", "ver", "ti", "st", "ou"]
    some = words or syllables
    word = lambda k=2: "".join(r.choice(r.choice((some, syllables))) for _ in range(k))
    plain = lambda k: "".join(r.choice(syllables) for _ in range(k))
    signs = "!@#$%^&*"
    text = lambda: " ".join(word(1) for _ in range(r.randint(2, 6)))  # noqa: E731  (no word long enough to be a candidate)
    names = ["token", "secret", "password", "passwd", "api_key", "access_key", "auth_token", "client_secret", "credential", "private_key"]
    sign = lambda: r.choice(["=", " = ", ": ", ":"])
    quote = lambda x: r.choice(["{}", '"{}"', "'{}'"]).format(x)
    true = [
        lambda: r.choice(names) + sign() + quote(pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: r.choice(names) + sign() + quote(pick(lower + upper + digits, r.randint(18, 48))),
        lambda: r.choice(names) + sign() + quote(pick(lower + upper + digits + "+/", 40) + "=="),
        lambda: r.choice(["AKIA", "ASIA"]) + pick(upper + digits, 16),
        lambda: r.choice(["key ", "use ", ""]) + r.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "AIza", "glpat-"]) + pick(lower + upper + digits, r.randint(20, 36)),
        lambda: r.choice(names[:4]) + sign() + quote(pick(lower, 3) + pick(digits, 2) + pick(upper, 2) + pick(signs, 1) + pick(lower + digits, r.randint(1, 6))),
        lambda: r.choice(names[:4]) + sign() + quote(pick(lower + upper + digits, r.randint(9, 15))),
        lambda: "eyJ" + pick(lower + upper + digits, 20) + "." + pick(lower + upper + digits + "-_", 40) + "." + pick(lower + upper + digits + "-_", 43),
        lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + pick(lower + upper + digits + "+/", 64) + "\n" + pick(lower + upper + digits + "+/", 48) + "==\n-----END RSA PRIVATE KEY-----",
        lambda: "Authorization: Bearer " + pick(lower + upper + digits + "-_", r.randint(24, 60)),
    ]
    false = [
        lambda: plain(r.randint(6, 10)),
        lambda: plain(r.randint(6, 10)).capitalize(),
        lambda: "".join(r.choice("bcdfghlmnprstvw") + r.choice(("a", "e", "i", "o", "u", "on", "er", "st")) for _ in range(r.randint(7, 10))),
        lambda: word(r.randint(6, 9)),
        lambda: word(r.randint(6, 9)).capitalize(),
        lambda: "_".join(word() for _ in range(4)) + "_" + word(),
        lambda: "-".join(word() for _ in range(4)) + "-" + pick(digits, 4),
        lambda: "".join(word().capitalize() for _ in range(5)),
        lambda: r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "etag ", "revision "]) + pick(hexes, r.choice([32, 40])),
        lambda: r.choice(["uuid ", "id ", ""]) + "-".join(pick(hexes, n) for n in (8, 4, 4, 4, 12)),
        lambda: "https://" + word() + ".example.com/" + "/".join(word(2) for _ in range(4)) + "/" + pick(digits, 5),
        lambda: "/usr/local/" + "/".join(word() for _ in range(4)) + ".txt",
        lambda: pick(digits, r.randint(16, 24)),
        lambda: pick("-_", 1) * r.randint(16, 40),
        lambda: r.choice(names[:4]) + sign() + word(r.randint(2, 3)) + "-" + word(2),
        lambda: r.choice(names[:4]) + sign() + quote(r.choice(["changeme-example", "your_password_here", "os.environ.value", "get_from_config", "placeholder"])),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper() + "_" + word().upper(),
    ]
    rows = [(f"{text()} {shape()} {text()}", label) for label, shapes in ((1.0, true), (0.0, false)) for shape in shapes for _ in range(each * (2 if label else 1))]
    return spark.createDataFrame(rows, "text string, label double")


def train(findings: DataFrame, words: list[str], trees: int = 24, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """A forest from labelled findings (text, label): the candidates of a text carry its label."""
    rows = with_features(candidates(findings.withColumn("doc_id", F.struct(F.monotonically_increasing_id().alias("i"), "label"))), words)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumn("label", F.col("id.label")))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(ready.select("features", "label"))


def secrets(
    docs: DataFrame, model: RandomForestClassificationModel | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    words: list[str] | None = None,
) -> DataFrame:
    """One row per secret: id, start, length, secret_sha256, score.

    The secret itself is not returned, only its place and digest. The dictionary is the
    corpus's own unless ``words`` are given. Null and empty texts hold none; very long
    texts give a row a candidate; repeated rows give repeated findings; a null id is kept;
    an empty table gives no rows; further columns are ignored.
    """
    words = dictionary(docs, text_col=text_col) if words is None else words
    model = model or train(labelled_findings(docs.sparkSession, words), words)
    rows = with_features(candidates(docs, id_col, text_col), words)
    judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return judged.withColumn("score", score).where(F.col("score") >= threshold).select(
        F.col("id").alias(id_col), F.col("start").cast("long").alias("start"), F.char_length("found").alias("length"), F.sha2("found", 256).alias("secret_sha256"), "score")
