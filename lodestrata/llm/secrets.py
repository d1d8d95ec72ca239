"""Secret scans: regular-expression candidates, judged by a random forest.

Candidates are runs of 16 or more characters of keys and hashes with a digit, tokens with
an issuer's prefix, values of 6 or more characters after a named assignment, and
passwords in connection strings. Each has its length, character classes and transitions,
coverage by a dictionary (the most frequent words of the corpus), its path, whether names
stand near and which word comes before it. That word counts by its log odds among
labelled findings of one half; the forest is trained on the other half. It removes the
false positives. Its trees are read once and written as one SQL expression, so that
judging and redacting need no shuffle; all of it is DataFrame functions and spark.ml.

Labelled findings come from the caller, or from ``weak_labels``: a named assignment or
an issuer's prefix is a secret, plain numbers, UUIDs and digests named as such are not.
The rules' own flags (RULES) are no features, so the forest judges by shape and
neighbours. At most SAMPLE findings of each label are used, in hash order (equal hashes
count as one finding). ``held_out`` measures precision and recall on findings that were
not trained on.

Cases: null and empty texts have no findings; very long texts are read whole; a null path
counts as empty; a score of exactly one half is a secret; repeated rows return repeated
findings; with findings of one label only, that label's rule stands in for the forest
(unlabelled candidates count as no secret); an empty table returns no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, written

CONTEXT = 48
MASK = "[SECRET]"
SAMPLE = 5000
WORDS = 300
#: Neighbouring words whose odds are kept.
NEIGHBOURS = 200
TREES, DEPTH, SEED = 15, 5, 2

#: Names that announce a secret, or another kind of long string; prefixes of issuers.
NAMED = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|bearer|auth)"
ASSIGNED = "(?:" + NAMED + r"[A-Za-z0-9_-]{0,16}[\"']?\s{0,3}(:|=|=>|:=)?\s{0,3}[\"']?|://[^\s:/@]{0,32}:)$"
HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|uuid|guid|isbn|phone|order|invoice|card|version|revision)[\"':=\s#]{0,5}$"
ISSUED = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[opsu]_[A-Za-z0-9]{36}|^xox[abprs]-|^sk[-_](live|test)?[-_]?[A-Za-z0-9]{16,}|^AIza[A-Za-z0-9_-]{35}$|^eyJ[A-Za-z0-9_-]{16,}"
# Short looks behind stand before long ones, which are slow.
#: A long run with a digit; an issued token; a value after a named assignment or in a connection string.
LONG = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9+/_-])|gh[opsu]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk[-_](?:live|test)?[-_]?[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35,}+|eyJ[A-Za-z0-9_-]{16,}+)"
VALUE = r"(?<=[\s=:>\"'])(?<=[=:>]\s{0,3}[\"']?)(?<=" + NAMED + r"[A-Za-z0-9_-]{0,16}[\"']?\s{0,3}(?:=>|:=|:|=)\s{0,3}[\"']?)(?![=:>])[^\s\"'`<>\[\]]{6,}+"
IN_URL = r"(?<=:)(?<=://[^\s:/@]{0,32}:)[^\s@/]{3,}+(?=@)"
CANDIDATE = f"(?:{LONG}|{TOKEN}|{VALUE}|{IN_URL})"
NUMBER_OR_UUID = r"^[0-9-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"

FEATURES = ["length", "digits", "upper", "lower", "signs", "transitions", "variety", "coverage", "slashes", "path_depth", "path_trial", "named", "quoted", "neighbour"]
#: Flags of the labelling rules, for the rows alone.
RULES = ["assigned", "harmless", "issued"]
RAW = ["value", "at", "left", "right"]


def dictionary(docs: DataFrame, n: int = WORDS) -> list[str]:
    """The n most frequent words of 3 to 12 letters, over all documents."""
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    counts = docs.select(word.alias("w")).where(F.length("w").between(3, 12)).groupBy("w").count()
    return [r.w for r in counts.orderBy(F.desc("count"), "w").limit(n).collect()]


def _length_without(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, ""))


def occurrences(text: str = "text") -> Column:
    """Candidates of a text: array of struct(value, at, left, right), null if there are none."""
    values = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)

    def one(p: Column) -> Column:
        def finding(value: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(p["gaps"], 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(p["values"], 1, i), F.lit(0), lambda n, x: n + F.length(x))
            near = F.least(before, F.lit(CONTEXT))
            left = F.substring(F.col(text), before - near + 1, near)
            right = F.substring(F.col(text), before + F.length(value) + 1, F.lit(CONTEXT))
            return F.struct(value.alias("value"), before.alias("at"), left.alias("left"), right.alias("right"))

        return F.transform(p["values"], finding)

    found = F.get(F.transform(F.array(F.struct(values.alias("values"), gaps.alias("gaps"))), one), F.lit(0))
    return F.when(F.col(text).rlike(CANDIDATE), found)


def _neighbour(left: Column) -> Column:
    """The last word before a value."""
    return F.lower(F.regexp_extract(left, r"([\p{L}_-]+)[^\p{L}_-]*$", 1))


def _features(f: Column, path: Column, words: list[str], odds: dict[str, float]) -> dict[str, Column]:
    value, left, right = f["value"], f["left"], f["right"]
    n = F.length(value).cast("double")
    share = lambda kind: 1.0 - _length_without(value, kind) / n
    flag = lambda c: c.cast("int").cast("double")
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "$^"
    path = F.coalesce(path, F.lit(""))
    neighbour = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(odds.items()) for x in (k, v)]), _neighbour(left)) if odds else F.lit(0.0)
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share("[^A-Za-z0-9]"),
        "transitions": F.regexp_count(value, F.lit("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])")) / n,
        "variety": F.size(F.array_distinct(F.split(value, ""))) / n,
        "coverage": 1.0 - _length_without(F.lower(value), known) / n,
        "slashes": (F.length(value) - F.length(F.replace(value, F.lit("/")))).cast("double"),
        "path_depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"),
        "path_trial": flag(path.rlike("(?i)test|example|sample|fixture|mock|docs?/")),
        "named": flag(left.rlike(NAMED)),
        "quoted": flag(left.rlike("[\"'`]$") & right.rlike("^[\"'`]")),
        "neighbour": F.coalesce(neighbour, F.lit(0.0)),
        "assigned": flag(left.rlike(ASSIGNED)),
        "harmless": flag(left.rlike(HARMLESS)),
        "issued": flag(value.rlike(ISSUED)),
    }


def weak_labels(f: Column) -> Column:
    """1, 0 or null for a finding, from its value and left context alone."""
    value, left = f["value"], f["left"]
    plain_word = value.rlike(r"^\p{L}+[.,;:!?)]*$") & ~left.rlike("[\"']$")  # as in prose: undecided
    named = left.rlike(ASSIGNED) & ~left.rlike(HARMLESS) & ~plain_word
    plain = value.rlike(NUMBER_OR_UUID) | left.rlike(HARMLESS)
    return F.when(value.rlike(ISSUED) | (named & ~value.rlike(r"^[0-9-]+$")), 1.0).when(plain, 0.0)


class Scanner:
    """A dictionary, the odds of neighbouring words, and the forest as a SQL expression."""

    def __init__(self, words: list[str]):
        self.words, self.odds = words, {}
        self.score = lambda f: F.when(f["issued"] + f["assigned"] * (1 - f["harmless"]) > 0, 1.0).otherwise(0.0)

    def judged(self, found: Column, path: str = "source") -> Column:
        """found, as ``occurrences`` gives it, with features, flags, score and secret."""

        def describe(f: Column) -> Column:
            return F.struct(*[f[k].alias(k) for k in RAW], *[c.alias(k) for k, c in _features(f, F.col(path), self.words, self.odds).items()])

        def rate(f: Column) -> Column:
            return F.struct(*[f[k].alias(k) for k in [*RAW, *FEATURES, *RULES]], self.score(f).alias("score"))

        scored = F.transform(F.transform(found, describe), rate)
        return F.transform(scored, lambda f: f.withField("secret", f["score"] >= 0.5))


def _tree(node, f: Column) -> Column:
    """A tree of spark.ml as nested CASE over the finding's features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(f[FEATURES[split.featureIndex()]] <= split.threshold(), _tree(node.leftChild(), f)).otherwise(_tree(node.rightChild(), f))


def train(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> Scanner:
    """findings: rows (f, path, label) with f as ``occurrences`` gives it."""
    scanner = Scanner(dictionary(docs))
    if findings is None:
        findings = docs.select(F.explode(occurrences()).alias("f"), F.col("source").alias("path")).withColumn("label", weak_labels(F.col("f")))
    mark = F.xxhash64("f.value", "f.left", "f.right")
    labelled = findings.where("label IS NOT NULL").select("f", "path", "label", mark.alias("mark")).dropDuplicates(["mark"])
    first = lambda label: labelled.where(F.col("label") == label).orderBy("mark").limit(sample)
    picked = written(first(1).unionByName(first(0)).coalesce(1))
    if picked.select("label").distinct().count() < 2:
        return scanner
    half = F.pmod("mark", F.lit(2))
    counts = picked.where(half == 0).groupBy(_neighbour(F.col("f.left")).alias("w")).agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
    common = counts.orderBy(F.desc(F.col("ones") + F.col("zeros")), "w").limit(NEIGHBOURS)
    scanner.odds = {r.w: r.odds for r in common.select("w", F.log((F.col("ones") + 0.5) / (F.col("zeros") + 0.5)).alias("odds")).collect()}
    other = picked.where(half == 1)
    if other.select("label").distinct().count() < 2:
        other = picked
    rows = other.select("label", *[c.alias(k) for k, c in _features(F.col("f"), F.col("path"), scanner.words, scanner.odds).items()])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(rows)
    roots = [t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode") for t in forest.trees]

    def score(f: Column) -> Column:
        total = F.lit(0.0)
        for r in roots:
            total = total + _tree(r, f)
        return total / len(roots)

    scanner.score = score
    return scanner


def findings(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), scanner: Scanner | None = None) -> DataFrame:
    """One row a candidate: the kept columns, finding (its number in the text), at, length,
    left, value, the features, the rules' flags, score, secret. Candidates are written, so
    that training and judging read the texts once."""
    f, path = fresh(docs.select(*keep), "f", "path")
    own = docs.select(*keep, *[c for c in ("text", "source") if c not in keep])
    raw = written(own.select(*keep, F.col("source").alias(path), F.posexplode(occurrences()).alias("finding", f)))
    if scanner is None:
        labelled = raw.select(F.col(f).alias("f"), F.col(path).alias("path")).withColumn("label", weak_labels(F.col("f")))
        scanner = train(docs, labelled)
    judged = raw.select(*keep, "finding", F.get(scanner.judged(F.array(f), path), F.lit(0)).alias(f))
    return judged.select(*keep, "finding", f"{f}.*")


def held_out(docs: DataFrame, findings: DataFrame | None = None, parts: int = 5) -> tuple[float, float]:
    """Precision and recall on every parts-th labelled finding, trained on the others."""
    if findings is None:
        findings = docs.select(F.explode(occurrences()).alias("f"), F.col("source").alias("path")).withColumn("label", weak_labels(F.col("f")))
    findings = written(findings.where("label IS NOT NULL"))
    part = F.pmod(F.xxhash64("f.value", "f.left", "f.right", F.lit("held out")), F.lit(parts))
    scanner = train(docs, findings.where(part != 0))
    judged = findings.where(part == 0).select("label", F.get(scanner.judged(F.array("f"), "path"), F.lit(0))["secret"].alias("secret"))
    r = judged.agg(F.count_if(F.col("secret")).alias("said"), F.count_if(F.col("label") == 1).alias("true"), F.count_if(F.col("secret") & (F.col("label") == 1)).alias("both")).first()
    return (r.both / r.said if r.said else 1.0, r.both / r.true if r.true else 1.0)


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Every secret replaced by MASK, n_chars set anew; all documents stay."""
    scanner = scanner or train(docs)
    gaps = F.split("text", CANDIDATE, -1)
    found = fresh(docs, "_f")[0]
    hidden = F.transform(found, lambda f: F.when(f["secret"], F.lit(MASK)).otherwise(f["value"]))
    pieces = F.zip_with(gaps, hidden, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
    clean = F.when(F.exists(found, lambda f: f["secret"]), F.array_join(pieces, "")).otherwise(F.col("text"))
    marked = docs.withColumn(found, scanner.judged(occurrences()))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(clean.alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.exists(found, lambda f: f["secret"]), F.char_length(clean)).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))
        else:
            columns.append(F.col(c))
    return marked.select(*columns)
