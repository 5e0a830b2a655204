"""Secret scans: candidates by pattern, false positives removed by a random forest.

A pattern finds candidates; each is described by its length, changes of character class, how much
of it a dictionary covers, whether it is part of a path, and the words beside it. A random forest
fitted to labelled findings decides. Its trees become one SQL expression that is evaluated within the
row, so nothing is exploded, shuffled or sent to Python.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, unwrapped, wrapped

#: What may be a secret: fixed patterns. Values assigned to a telling name, keys that name their issuer, and long runs of letters and digits that have a digit.
#: No pattern has an upper bound: a candidate covers its whole run. Runs are entered at their start only, so time stays linear.
RUN = r"[A-Za-z0-9][A-Za-z0-9_+/.\-]{14,}[A-Za-z0-9]"
KEYED = r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:gh[opsru]_|github_pat_|glpat-|sk_live_|rk_live_|npm_)[A-Za-z0-9_\-]{16,})(?![A-Za-z0-9_])"
#: Words beside a secret, and beside what only looks like one: fixed values.
TELLING = r"(?i)(pass(word|wd|phrase|code)?|pwd|secret([_-]?key)?|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(orization)?|bearer|credential|client[_-]?secret)"
HARMLESS = r"(?i)(commit|sha(1|256)?|md5|checksum|digest|hash|revision|uuid|guid|etag|version|build|order|invoice|isbn|card|phone|href|src|https?)"
#: Between a telling name and its value: part of a match, as its length has no bound, but not of the value.
SIGN = r"[\"']?\s*+[=:]\s*+[\"']?(?:(?i:bearer|basic)\s++)?"
NAMED = rf"(?<=(?i:{TELLING.removeprefix('(?i)')}))"
ASSIGNED = rf"(?=[\"'\s=:])(?<=[A-Za-z])(?=[\"']?\s*+[=:]){NAMED}{SIGN}[^\s\"',;]{{6,}}"
# A run leaves a telling name its equals sign.
CANDIDATE = rf"{ASSIGNED}|{KEYED}|(?<![A-Za-z0-9_+/.@\-])(?=[A-Za-z_+/.\-]*[0-9]){RUN}(?:(?<!(?i:{TELLING.removeprefix('(?i)')}))={{1,2}})?(?![A-Za-z0-9@])"
#: Prefixes of keys that name their issuer: fixed values.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|ya29\.|eyJ|SG\.|npm_|pypi-)"
#: The dictionary of coverage: common words of the languages and of code, fixed values.
DICTIONARY = (
    "about access account action address after again also analysis and another application archive article back base because been before being between board body book branch browser build business but button "
    "cache call case change chapter check child city class client code come comment common company complete config content control count country create data date default delete description design detail "
    "device die directory display document does download each edit email end english error even event every example export family field file find first folder form format found from function general "
    "get group guide have header health help here high history home house html image import index info input install into item java json kind language last level library light like line link list little load "
    "local log long main make manager many map market media member memory menu message method model module more most name network never new news next not note number object office only open option "
    "other over page parent part password path people photo place plan point post print private process product program project public question random read record release report request resource result "
    "return right root sample school script search secret section see server service session setting short should show side simple site size some source start state still string style such system "
    "table tag test text than that the their them then there these they thing this time title token total tree type under unit update upload use user value version video view water web week what when "
    "where which while white will window with word work world would write year und der das nicht eine oder auch werden les des une pour dans avec sont que los las para como más pero ción"
).split()
#: Longest first, as the pattern takes the first that fits.
COVERING = "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w)))

FEATURES = ("length", "transitions", "coverage", "path", "telling", "harmless", "issued", "digits", "upper", "hex", "only_digits", "distinct")
#: Size of the forest, and of the labelled findings it is fitted to.
TREES, DEPTH, FINDINGS, SEED = 24, 6, 4000, 17
THRESHOLD = 0.5


def feature_columns(value: Column, before: Column, after: Column) -> list[Column]:
    """In the order of FEATURES, as doubles."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    low = F.lower(value)
    flag = lambda c: c.cast("double")
    return [
        n,
        F.regexp_count(value, F.lit(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z])")) / n,
        (n - F.length(F.regexp_replace(low, f"({COVERING})", ""))) / n,
        flag(value.rlike(r"/.*/|\.[a-z]{2,4}$|^\d+\.\d") | before.rlike(r"[/\\]$") | after.rlike(r"^[/\\]|^\.[a-z]{2,4}\b")),
        flag(before.rlike(TELLING + r"\W*$") | before.rlike(TELLING + r"\s+\S{0,12}\s*$")),
        flag(before.rlike(HARMLESS + r"\W*\w{0,3}\W*$")),
        flag(value.rlike(ISSUED)),
        F.regexp_count(value, F.lit("[0-9]")) / n,
        F.regexp_count(value, F.lit("[A-Z]")) / n,
        flag(value.rlike(r"^[0-9a-f]+$") & value.rlike("[a-f]")),
        flag(value.rlike(r"^[0-9.\-+]+$")),
        F.size(F.array_distinct(F.split(value, ""))) / n,
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(value, before, after, label): drawn from the shapes that reviewers of scans meet; a fixed number."""
    r = random.Random(seed)
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))
    pieces = [w for w in DICTIONARY if w.isascii()]
    # Words that the dictionary holds, and pronounceable ones that it doesn't.
    spoken = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice(["a", "e", "i", "o", "u", "ei", "ou", "er", "an", "in"]) for _ in range(r.randint(2, 5)))
    word = lambda: r.choice([lambda: r.choice(pieces), lambda: r.choice(pieces) + r.choice(pieces), spoken])()
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 5))) + " "
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "client_secret", "SECRET_KEY", "Authorization: Bearer"]
    quiet = ["commit", "sha256:", "sha1", "md5", "checksum", "digest", "uuid", "etag", "revision", "order", "invoice", "card", "build", "hash"]
    assign = lambda: r.choice(["=", " = ", ": ", "=\"", " = \"", ":"])
    named = ["password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "access_key", "private_key", "auth", "credential", "client_secret"]
    letters = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    swaps = str.maketrans("oeia", "0314")
    # Words that a person made a password of: letters swapped for digits, a number behind, another sign.
    chosen = lambda: r.choice([lambda w: w.translate(swaps) + str(r.randint(0, 99)), lambda w: w.capitalize() + str(r.randint(1, 9999)), lambda w: w + str(r.randint(1, 9999)) + letters(3).lower(), lambda w: w.capitalize().translate(swaps) + r.choice("!#$%&*") + str(r.randint(0, 9)), lambda w: w + str(r.randint(0, 9)) + word() + str(r.randint(0, 9)) + word().capitalize()])(word() + letters(3).lower())
    good = [
        lambda: ("AKIA" + upper(16), prose()),
        lambda: ("AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(16)), prose()),
        lambda: (r.choice(["ghp_", "gho_", "npm_"]) + mixed(36), prose()),
        lambda: ("sk_live_" + mixed(24), prose() + r.choice(names) + assign()),
        lambda: ("AIza" + mixed(35), prose()),
        lambda: (hexa(r.choice([16, 18, 20, 24, 32, 40, 64])), prose() + r.choice(names) + assign()),
        lambda: (mixed(r.randint(16, 64)), prose() + r.choice(names) + assign()),
        lambda: (mixed(r.randint(8, 20)), prose() + r.choice(names[:4]) + "="),
        lambda: (word() + str(r.randint(0, 9999)) + r.choice("!#$%&*"), prose() + r.choice(names[:4]) + r.choice(["=", ":"])),
        lambda: (r.choice([lambda: mixed(r.randint(6, 16)), lambda: hexa(r.randint(8, 16)), lambda: letters(r.randint(10, 40)), chosen])(), prose() + r.choice(named) + assign()),
        lambda: (mixed(40), prose() + r.choice(["aws_secret_access_key", "private_key", "credential"]) + assign()),
        lambda: ("eyJ" + mixed(r.randint(30, 90)) + "." + mixed(40), prose()),
    ]
    bad = [
        lambda: (hexa(r.choice([32, 40, 64])), prose() + r.choice(quiet) + " "),
        lambda: (hexa(r.choice([32, 40, 64])), prose()),
        lambda: ("-".join(hexa(k) for k in (8, 4, 4, 4, 12)), prose() + r.choice(["uuid ", "id ", "guid=", ""])),
        lambda: ("".join(r.choice("0123456789") for _ in range(r.choice([16, 16, 18, 20]))), prose() + r.choice(["", "card ", "order ", "invoice "])),
        lambda: ("/".join(word() for _ in range(r.randint(2, 5))) + "/" + word() + str(r.randint(0, 99)) + r.choice([".py", ".html", ".json", ".png"]), prose() + r.choice(["", "/", "src=", "href="])),
        lambda: ("-".join(word() for _ in range(r.randint(2, 5))) + "-" + str(r.randint(0, 2030)), prose()),
        lambda: (word() + word() + word() + str(r.randint(0, 99)), prose()),
        lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)) + "." + word(), prose()),
        lambda: ("20" + str(r.randint(10, 30)) + "-" + str(r.randint(10, 12)) + "-" + str(r.randint(10, 28)) + "T" + str(r.randint(10, 23)) + "0000Z", prose()),
        lambda: ("_".join(word() for _ in range(3)) + "_v" + str(r.randint(1, 9)) + word(), prose() + r.choice(["version ", "build ", ""])),
        lambda: (word() + "_" + word() + str(r.randint(1, 99)) + "_" + word(), prose() + r.choice(["token ", "key ", "password "])),
        lambda: (r.choice([word, lambda: word() + word(), lambda: word() + "_" + word(), lambda: word() + "." + word(), lambda: word() + "()"])(), prose() + r.choice(named) + assign()),
    ]
    out = []
    for i in range(n):
        label = i % 2
        value, before = r.choice(good if label else bad)()
        out.append((value, before[-64:], r.choice(['"', " ", ".", ";", "\n", ","]) + prose(), label))
    return out


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """A random forest over findings (value, before, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in zip(FEATURES, feature_columns(F.col("value"), F.col("before"), F.col("after")), strict=True)])
    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=4, subsamplingRate=0.8).fit(made)


#: A tree: (feature, threshold, left, right), or the share of secrets in a leaf.
Tree = tuple | float


def trees_of(forest) -> list[Tree]:
    def walk(node) -> Tree:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return round(stats[1] / max(sum(stats), 1e-9), 6) if len(stats) > 1 else 0.0
        split = node.split()
        return split.featureIndex(), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._call_java("rootNode")) for t in forest.trees]


_FORESTS: dict[tuple, list[Tree]] = {}


def default_forest(spark: SparkSession) -> list[Tree]:
    """The forest fitted to the built-in findings, once in a session's driver."""
    if () not in _FORESTS:
        # As VALUES the findings stay in the JVM.
        quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
        rows = ", ".join(f"({quote(v)}, {quote(b)}, {quote(a)}, {y})" for v, b, a, y in labelled_findings())
        _FORESTS[()] = trees_of(fit(spark.sql(f"SELECT * FROM VALUES {rows} AS t(value, before, after, label)")))
    return _FORESTS[()]


def forest_score(forest: list[Tree], features: Column) -> Column:
    """The mean over the trees; features is an array of doubles."""

    def walk(tree: Tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        i, threshold, left, right = tree
        if left == right:
            return walk(left)
        return F.when(features[i] <= threshold, walk(left)).otherwise(walk(right))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


def scan(docs: DataFrame, forest: list[Tree] | None = None, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "_") -> DataFrame:
    """docs with `_candidates` (their number), `_findings` and `_redacted`.

    _findings: array<struct<start, length, value, score>>, in code points of the text, in order.
    _redacted: the text with [SECRET] in place of each finding; unchanged texts stay as they are.
    Null texts have no findings and stay null. All rows and columns stay, but for those of the three names; another prefix than
    `_` spares them.
    """
    forest = default_forest(docs.sparkSession) if forest is None else forest
    text = field(text_col)
    found = F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))
    some = wrapped(docs).withColumn("_matches", found)
    # Runs and keys begin with a letter or digit: only matches of an assigned value begin with a sign, which goes to the part before.
    some = some.withColumn("_signs", F.transform("_matches", lambda m: F.regexp_extract(m, f"^{SIGN}", 0)))
    some = some.withColumn("_values", F.zip_with("_matches", "_signs", lambda m, s: F.substring(m, F.length(s) + 1, F.length(m))))
    some = some.withColumn("_between", F.when(F.col("_values").isNotNull(), F.split(text, CANDIDATE, -1)))
    some = some.withColumn("_parts", F.zip_with("_between", F.concat("_signs", F.array(F.lit(""))), lambda p, s: F.concat(p, s)))
    # White space of a sign counts as one, so that the words before it are seen however long it is.
    # A candidate may end where the next one's sign begins: it's part of what stands before.
    before = lambda i: F.concat(F.right(F.concat(F.coalesce(F.get("_values", i - 1), F.lit("")), F.element_at("_between", i + 1)), F.lit(64)), F.regexp_replace(F.element_at("_signs", i + 1), r"\s+", " "))
    each = F.transform(
        "_values",
        lambda v, i: F.struct(
            v.alias("value"),
            F.array(*feature_columns(v, before(i), F.left(F.element_at("_parts", i + 2), F.lit(64)))).alias("features"),
        ),
    )
    some = some.withColumn("_each", each)
    some = some.withColumn("_scored", F.transform("_each", lambda x: F.struct(x["value"].alias("value"), forest_score(forest, x["features"]).alias("score"))))
    # Where candidates start: lengths are added up within blocks of 256 candidates, and the blocks before are added once each.
    some = some.withColumn("_steps", F.zip_with(F.slice("_parts", 1, F.size("_values")), "_values", lambda p, v: F.length(p) + F.length(v)))
    sums = lambda first, n: F.aggregate(F.slice("_steps", first, n), F.lit(0), lambda a, x: a + x)
    some = some.withColumn("_bases", F.transform(F.sequence(F.lit(0), F.floor(F.size("_values") / 256).cast("int")), lambda b: sums(F.lit(1), b * 256)))
    starts = F.transform(
        "_scored",
        lambda x, i: F.struct(
            (F.element_at("_bases", F.floor(i / 256).cast("int") + 1) + sums(F.floor(i / 256).cast("int") * 256 + 1, i % 256) + F.length(F.element_at("_parts", i + 1))).alias("start"),
            F.length(x["value"]).alias("length"),
            x["value"].alias("value"),
            x["score"].alias("score"),
        ),
    )
    kept = F.filter(starts, lambda x: x["score"] >= threshold)
    shown = F.transform("_scored", lambda x: F.when(x["score"] >= threshold, F.lit("[SECRET]")).otherwise(x["value"]))
    rebuilt = F.array_join(F.zip_with("_parts", F.concat(shown, F.array(F.lit(""))), lambda p, v: F.concat(p, v)), "")
    return unwrapped(some, docs.columns, {
        f"{prefix}candidates": F.when(F.col("_values").isNull(), 0).otherwise(F.size("_values")).cast("long"),
        f"{prefix}findings": F.coalesce(kept, F.array().cast("array<struct<start: int, length: int, value: string, score: double>>")),
        f"{prefix}redacted": F.when(F.col("_values").isNull(), text).otherwise(rebuilt),
    })
