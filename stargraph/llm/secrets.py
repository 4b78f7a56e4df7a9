"""Secret scanning with a random forest that removes false positives (DataFrame operations and Spark ML only).

``candidates``   in a whole text, with the characters before and after each and the path it was found under:
                 the value after a credential name and ``=`` or ``:`` (or after ``Bearer``), quoted or not, of
                 ``MIN_VALUE`` or more characters of any kind; the password in ``scheme://user:password@host``; a
                 token of dotted parts (JWT); every other run of 16 or more of ``[A-Za-z0-9+/_-]`` (up to two ``=``
                 after it).  A value with blanks in it counts only in quotes that close on the same line; otherwise it
                 ends at the first blank.  No value is too long.
``features``     length, shares of character classes, transitions between classes and between vowels and
                 consonants, coverage by a dictionary of common words, the shape of the path, and the
                 neighbouring words (assignment, quotes, credential names).
``fit``          a random forest over labelled findings.  At most ``MAX_PER_LABEL`` of each label are used, the first
                 by a hash (a documented bound: the forest is small, the candidates that it judges are all), and
                 both labels weigh the same, so that rare secrets are neither missed nor outvoted.
``score``        the forest's vote for every candidate; a secret has ``score >= THRESHOLD``.

``weak_labels`` supplies labelled findings where no reviewed ones exist: a quoted value assigned to a credential
name is a secret if it mixes letters and digits, and so is a key in an issuer's own format; a placeholder or a common word assigned to one is not, nor is what
has no credential name before it, unless its own shape is that of a key.  Everything else (such as unquoted values
of credential names) is not reviewed: it is scored and does not teach.  Some features overlap with that rule, so a
forest learned from it reproduces the rule; it is a stand-in for reviewed findings.

Nulls: a null text has no candidates; a null path is an empty path; null ids stay.  Repeated rows give repeated
findings.  Without labelled findings, or with one class only, every candidate keeps that class (1.0 without
labels, so nothing is removed unseen).  An empty table gives an empty result.  Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stargraph.llm.common import materialize, text_or_empty

MAX_PER_LABEL = 5_000
TREES = 20
DEPTH = 6
SEED = 8
THRESHOLD = 0.5
AROUND = 48  # characters kept before and after a candidate

MIN_VALUE = 4  # characters of the shortest value after a credential name: fewer are no secret
USER = 4096  # characters of the longest user name in a URL (look-behinds are bounded)

#: ``auth`` but not ``author`` (``authorization`` is one).
NAMES = r"token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth(?!or(?!i[sz]))|credential|bearer"
CREDENTIAL = f"(?i)({NAMES})"

_RUN = "[A-Za-z0-9+/_-]"
_QUOTE = r"\\{0,3}[\"'`]"
_NAMED = (  # a word with a credential name in it and = or : (also => and :=), or the word Bearer
    rf"(?:{_RUN}*?(?=[a-cpstA-CPST])(?i:{NAMES})[A-Za-z0-9_.-]{{0,64}}(?:{_QUOTE})?\]?[^\S\r\n]*[:=]{{1,2}}>?[^\S\r\n]*"
    r"(?:(?i:bearer|basic|token)[^\S\r\n]+)?|(?i:bearer)[^\S\r\n]+)"
)
_END = (  # another name or entry, a tag, a quote that closes, or marks before a blank
    rf"(?:(?:{_QUOTE})?[&;,|](?:{_QUOTE})?[\w.-]{{1,64}}(?:{_QUOTE})?\x20?[=:]|<[/A-Za-z!]|{_QUOTE}[,;:)\]}}+>\\]"
    r"|[,;.)\]}\"'`]{0,8}(?:\s|$))"
)
#: Group 1 is what stands before the value of a credential name, group 2 the quote that opens it.
CANDIDATE = (
    rf"(?<=:)(?<=://[^\s/:@\"'`<>]{{0,{USER}}}:)[^\s/\"'`<>?#]{{{MIN_VALUE},}}(?=@)"
    rf"|(?<!{_RUN})(?={_RUN})(?:({_NAMED}({_QUOTE})?)"
    rf"(?:(?<=[\"'`])(?=\S|[^\S\r\n]+[^\s\"'`])(?:(?!\2)(?:\\.|[^\r\n\\])){{{MIN_VALUE},}}+(?=\2)"
    rf"|(?!{_QUOTE})(?!\S{{0,{MIN_VALUE - 1}}}?{_END})\S{{{MIN_VALUE},}}?(?={_END}))"
    rf"|eyJ[A-Za-z0-9_-]{{5,}}(?:\.[A-Za-z0-9_-]{{4,}}){{1,4}}"
    rf"|{_RUN}{{16,}}={{0,2}})"
)

#: Keys in a format that one issuer alone gives out, and how other keys begin.
ISSUED = (
    r"^((AKIA|ASIA)[A-Z0-9]{16}|AIza[A-Za-z0-9_-]{35}|gh[opsur]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,})$"
)
KEY_SHAPE = r"^(eyJ|AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|sk[_-]|pk_|MII)"
PLACEHOLDER = (
    r"(?i)^(\$\{[^}]*\}?|\$\([^)]*\)?|\{\{.*|<[^>]*>?|\*+|x{6,}|your[_ -].*|(os|process|self|config|settings|env)\.[a-z_.]+"
    r"|none|null|undefined|true|false|string|required|optional|redacted|placeholder)$"
)

#: Common words of the dictionary feature (fixed values).
DICTIONARY = (
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two "
    "way who boy did its let put say she too use that with have this will your from they know want been good much some "
    "time tion ing ment der die und den von mit sich des auf ist dem nicht ein eine auch als nach ung heit keit lich "
    "schen les des est une dans que qui par pour sur pas plus avec eau ment tre los las por con para una del sus como "
    "pero esta est ado ente example test sample data name value user code file path http https www com org net"
).split()


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """``doc_id, nth, path, value, before, after``: the nth candidate (from 0) of each text.

    The text is split at the candidates, so what stands around each is at hand without searching again.
    """
    text = text_or_empty(F.col("text"))
    found = docs.select(
        "doc_id",
        F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("whole"),
        text.alias("text"),
    ).filter(F.size("whole") > 0)
    # the name belongs to what stands before the value
    found = found.withColumn("names", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)))
    values = F.zip_with("whole", "names", lambda w, n: F.substr(w, F.length(n) + 1))
    gaps = F.zip_with(F.split("text", CANDIDATE, -1), F.concat("names", F.array(F.lit(""))), lambda g, n: F.concat(g, n))
    between = F.transform(gaps, lambda p: F.struct(F.left(p, F.lit(AROUND)).alias("l"), F.right(p, F.lit(AROUND)).alias("r")))
    return found.select("doc_id", "path", values.alias("values"), between.alias("between")).select(
        "doc_id",
        "path",
        F.posexplode(
            F.zip_with(
                F.zip_with(F.slice("between", F.lit(1), F.size("values")), "values", lambda p, v: F.struct(p["r"].alias("b"), v.alias("v"))),
                F.slice("between", F.lit(2), F.size("values")),
                lambda x, p: F.struct(x["v"].alias("value"), x["b"].alias("before"), p["l"].alias("after")),
            )
        ).alias("nth", "f"),
    ).select("doc_id", "nth", "path", "f.value", "f.before", "f.after")


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """``found`` with one double column per feature, and their names."""
    value, before, after, path = (F.col(c) for c in ("value", "before", "after", "path"))
    length = F.length(value).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / length

    flag: Callable[[Column], Column] = lambda c: c.cast("double")
    covered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w))), ""))
    columns = {
        "length": length,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "marks": share("[+/_=-]"),
        "other_marks": share("[^A-Za-z0-9+/_=-]"),
        "kind_changes": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"),
        "case_changes": share("(?<=[a-z])(?=[A-Z])"),
        "vowel_changes": share("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])"),
        "repeats": share(r"(.)(?=\1)"),
        "variety": F.size(F.array_distinct(F.split(value, ""))) / length,
        "dictionary": F.lit(1.0) - covered / length,
        "path_depth": F.regexp_count(path, F.lit("/")).cast("double"),
        "path_test": flag(path.rlike(r"(?i)(test|example|sample|fixture|doc)")),
        "path_config": flag(path.rlike(r"(?i)\.(env|ini|cfg|conf|ya?ml|json|toml|properties)$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted_before": flag(before.rlike(r"[\"']$")),
        "quoted_after": flag(after.rlike(r"^[\"']")),
        "credential_near": flag(before.rlike(CREDENTIAL)),
        "credential_last": flag(before.rlike(CREDENTIAL + r"[\w.-]{0,64}\W*$")),
        "issued": flag(value.rlike(ISSUED)),
        "alone": flag(after.rlike(r"^(\s|$)") & before.rlike(r"(^|\s)$")),
    }
    return found.select("*", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"x_{n}") for n, c in columns.items()]), [
        f"x_{n}" for n in columns
    ]


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label`` from the assignment rule: 1.0, 0.0 (clear non-secrets) or null (not reviewed)."""
    value, before = F.col("value"), F.col("before")
    assigned = before.rlike(r"(?i)\b(token|secret|password|passwd|api_?key|access_?key|private_?key)\s{0,2}[=:]\s{0,2}[\"']$")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    named = before.rlike(CREDENTIAL) | value.rlike(CREDENTIAL + r"[\w.-]*[=:]")
    shaped = value.rlike(KEY_SHAPE) | before.rlike(r"://[^\s/:@]*:$")
    issued = value.rlike(ISSUED) & ~value.rlike("(?i)example")
    plain = value.rlike(PLACEHOLDER) | F.lower(value).isin(sorted(set(DICTIONARY)))
    return found.withColumn(
        "label",
        F.when(plain, 0.0).when(issued | (assigned & mixed & F.col("after").rlike("^[\"']")), 1.0).when(~named & ~shaped, 0.0),
    )


def fit(labelled: DataFrame, names: list[str], max_per_label: int = MAX_PER_LABEL) -> Callable[[DataFrame], DataFrame]:
    """A scorer learned from rows of features and ``label``; it adds ``score`` (0 to 1)."""
    order = F.xxhash64(F.lit(SEED), "doc_id", "nth", "value")
    rows = labelled.select(*names, F.col("label").cast("double").alias("label"), order.alias("at"))
    labels = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect() if r.label is not None}

    def lowest(label: float) -> DataFrame:
        """The first rows by the hash; a bound on the hash leaves about twice as many to be sorted, however many there are."""
        own = rows.filter(F.col("label") == label)
        share = 2 * max_per_label / max(labels.get(label, 0), 1)
        if share < 0.5:
            own = own.filter(F.shiftrightunsigned("at", 1) < F.lit(int(share * 2**63)))
            return own.orderBy(F.shiftrightunsigned("at", 1), "at", *names).limit(max_per_label)
        return own.orderBy("at", *names).limit(max_per_label)

    first = [lowest(c) for c in (0.0, 1.0)]
    learned = materialize(first[0].unionByName(first[1]), "secret-learned")
    seen = {r.label: r.n for r in learned.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        only = float(*seen) if seen else 1.0
        return lambda rows: rows.withColumn("score", F.lit(only))
    weight = F.when(F.col("label") == 1.0, sum(seen.values()) / (2 * seen[1.0])).otherwise(sum(seen.values()) / (2 * seen[0.0]))
    assemble = VectorAssembler(inputCols=names, outputCol="_ss_x")
    forest = RandomForestClassifier(
        featuresCol="_ss_x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8
    )
    # sorted, so that the same findings give the same trees however they were partitioned
    taught = assemble.transform(learned.withColumn("weight", weight))
    model = forest.fit(taught.coalesce(1).sortWithinPartitions("label", "at", *names))

    def score(rows: DataFrame) -> DataFrame:
        voted = model.transform(assemble.transform(rows))
        return voted.withColumn("score", F.get(vector_to_array("probability"), 1)).drop(
            "_ss_x", "rawPrediction", "probability", "prediction"
        )

    return score


def scan(labelled: DataFrame, learn: Column) -> DataFrame:
    """``doc_id, nth, path, value, before, after, score, secret`` for every candidate in ``labelled``.

    ``labelled`` holds the candidates with a ``label`` (null: not reviewed); ``learn`` says which rows teach.
    """
    rows, names = features(labelled)
    score = fit(rows.filter(learn), names)
    return score(rows).select(
        "doc_id", "nth", "path", "value", "before", "after", "score", (F.col("score") >= THRESHOLD).alias("secret")
    )
