"""Secret scans: patterns propose candidates, a random forest removes the false ones.

Everything here is a DataFrame or SQL expression. A text is cut at its
candidates by one pattern, so that each candidate comes with what stands before
and behind it; features of the candidate and of its surroundings go to a random
forest that is trained on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A password-like name, which may end a longer one, and what stands between it and its value.
NAME = r"(?i:password|passwd|pwd|secret)"
SETTER = r"[\"']?\s{0,2}[:=]\s{0,2}[\"']?"
#: 16 or more token characters with a digit.
RUN = r"(?=[A-Za-z_+/\-]*+[0-9])[A-Za-z0-9_+/\-]{16,}+"
#: A run that isn't itself such a name before its value, or the value given to such a name. A longer name leaves a value that is one run to the first form.
CANDIDATE = rf"(?<![A-Za-z0-9_+/\-]){RUN}(?:(?<!{NAME})|(?!{SETTER}[^\s\"']{{8,}}))(?:={{1,2}}+(?![A-Za-z0-9_+/\-]))?|(?=[PpSs])(?:\b|(?!{NAME}{SETTER}{RUN}={{0,2}}(?:[\s\"'&;,]|$))){NAME}{SETTER}[^\s\"']{{8,}}"
ASSIGNED = rf"^{NAME}{SETTER}"
CONTEXT = 60
THRESHOLD = 0.5
MASK = "[SECRET]"

#: Common words for dictionary coverage, and words near secrets and near harmless numbers (plain lists of our own).
WORDS = "about account action address after again alpha archive article asset author backup batch before beta blog book branch build cache category chapter check class client cloud code color config content core count data debug default delta demo design detail device docs document download draft edit email entry error event example export feature field file final first folder format from gallery guide header home html image import index info input item java json lang large latest library license line link list local login main manager media menu message model module month name news number object option order output package page part patch path person photo point post preview price print product profile project python query random read record release report request result review sample script search section server service session setting share short simple site small source space start state static status story style summary system table task temp test text theme thing this thumb time title topic type update upload user value version video view week with word work world year"
NEAR_SECRET = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|client.?key)"
NEAR_HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|revision|uuid|guid|build|order|invoice|card|phone|tel|isbn|serial|version|etag|number|trace|example|sample|dummy|placeholder)"
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ|npm_|pypi-)"
FEATURES = ["f_len", "f_entropy", "f_digit", "f_upper", "f_lower", "f_hex", "f_digits_only", "f_switch", "f_vowel_pair", "f_repeat", "f_words", "f_slash", "f_path_before", "f_path_after", "f_near_secret", "f_near_harmless", "f_assigned", "f_quoted", "f_prefix"]


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, value, before, after): one row per candidate; start counts characters from 0.

    A null or empty text has none; repeated rows each have theirs.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    cut = rows.withColumn("__found", F.regexp_extract_all("__text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("__found") > 0)
    cut = cut.select(id_col, F.monotonically_increasing_id().alias("__row"), "__found", F.split("__text", CANDIDATE, -1).alias("__rest"))
    n = F.size("__found")
    # a candidate that the next one is assigned to is its name, and stands before it
    names = F.concat(F.array(F.lit("")), F.col("__found"))
    zipped = F.arrays_zip(F.col("__found").alias("found"), F.slice(names, F.lit(1), n).alias("name"), F.slice("__rest", F.lit(1), n).alias("ahead"), F.slice("__rest", F.lit(2), n).alias("behind"))
    each = cut.select(id_col, "__row", F.posexplode(zipped).alias("__i", "__x"))
    ahead = F.when(F.col("__x.ahead").rlike(f"^{SETTER}$"), F.concat("__x.name", "__x.ahead")).otherwise(F.col("__x.ahead"))
    each = each.select(id_col, "__row", "__i", F.col("__x.found").alias("found"), F.length("__x.ahead").alias("gap"), F.right(ahead, F.lit(CONTEXT)).alias("before"), F.left("__x.behind", F.lit(CONTEXT)).alias("after"))
    # where a candidate starts is a running sum over its own row
    w = W.partitionBy("__row").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    name = F.regexp_extract("found", ASSIGNED, 0)
    at = F.sum((F.col("gap") + F.length("found")).cast("long")).over(w) - F.length("found") + F.length(name)
    return each.select(id_col, at.alias("start"), F.substring("found", F.length(name) + 1, F.length("found")).alias("value"), F.concat("before", name).alias("before"), "after")


def _share(pattern: str, of: str = "value") -> Column:
    return F.regexp_count(of, F.lit(pattern)) / F.greatest(F.length("value"), F.lit(1))


def featurise(found: DataFrame) -> DataFrame:
    """Adds the FEATURES to rows of value, before and after."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1))
    chars = F.array_distinct(F.split(v, ""))
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - F.when(c == "", 0.0).otherwise(((n - F.length(F.replace(v, c, F.lit("")))) / n) * F.log2((n - F.length(F.replace(v, c, F.lit("")))) / n)))
    known = r"(?i)(" + "|".join(sorted(WORDS.split(), key=lambda x: (-len(x), x))) + ")"
    yes = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return found.withColumns(
        {
            "f_len": F.length("value").cast("double"),
            "f_entropy": F.coalesce(entropy, F.lit(0.0)),
            "f_digit": _share("[0-9]"),
            "f_upper": _share("[A-Z]"),
            "f_lower": _share("[a-z]"),
            "f_hex": yes(v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "f_digits_only": yes(v.rlike("^[0-9+\\-]+$")),
            "f_switch": _share("[a-z](?=[0-9A-Z])|[A-Z](?=[0-9a-z])|[0-9](?=[A-Za-z])"),
            "f_vowel_pair": _share("(?i)[aeiou](?=[bcdfghjklmnpqrstvwxyz])"),
            "f_repeat": _share(r"(.)(?=\1)"),
            "f_words": (F.length(v) - F.length(F.regexp_replace(v, known, ""))) / n,
            "f_slash": _share("[/_\\-]"),
            "f_path_before": yes(F.col("before").rlike(r"(https?:|www\.|[./\\?&#])\S*$")),
            "f_path_after": yes(F.col("after").rlike(r"^[./\\:?&#]\w")),
            "f_near_secret": yes(F.col("before").rlike(NEAR_SECRET + r"[^.!?]{0,24}$")),
            "f_near_harmless": yes(F.concat_ws(" ", "before", "value", "after").rlike(NEAR_HARMLESS)),
            "f_assigned": yes(F.col("before").rlike(r"[:=]>?\s*[\"']?$")),
            "f_quoted": yes(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "f_prefix": yes(v.rlike(PREFIX)),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(value, before, after, label): findings made by rule, half of them false, the same on every run.

    They stand in for a reviewed list of findings; `train` takes any such table.
    """
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws(":", F.lit(k), i.cast("string")), 512)
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(h("b"))), "[\r\n]", "")
    digits = F.translate(h("d"), "abcdef", "174038")
    word = lambda k: pick(k, *WORDS.split()[::3])
    quote = pick("q", '"', "'", "", '"')
    name = pick("n", "token", "api_key", "apikey", "secret", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "private_key")
    setter = F.concat(name, pick("s", " = ", "=", ": ", ":", " => "), quote)
    text = pick("t", "of the ", "une la ", "der die ", "que los ", "see ", "and with ", "\n", "is. ", "")
    size = lambda k, *xs: pick(k, *xs).cast("int")
    cut = lambda c, n: F.substring(c, F.lit(1), n)
    kinds = [
        (1, cut(h("x"), size("z", 32, 40, 40, 64)), F.concat(text, setter), quote),
        (1, cut(F.translate(b64, "+/", "Aq"), size("z", 20, 24, 32, 40)), F.concat(text, setter), quote),
        (1, F.concat(pick("p", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "npm_", "AIza"), cut(F.translate(b64, "+/", "xZ"), size("z", 24, 32, 36))), F.concat(text, pick("c", "", "key ", "token = ", "use ")), F.lit(" ")),
        (1, F.concat(F.lit("AKIA"), F.upper(cut(F.translate(h("a"), "01", "XW"), F.lit(16)))), F.concat(text, pick("c", "", "aws ", "key: ")), F.lit(" ")),
        (1, F.concat(cut(b64, F.lit(6)), pick("m", "!", "#", "$9", "_", "%"), cut(h("w"), size("z", 3, 5, 8))), F.concat(text, pick("pw", "password", "passwd", "pwd", "PASSWORD"), pick("s", " = ", "=", ": ")), F.lit(" ")),
        (1, cut(h("x2"), size("z", 32, 40, 48)), F.concat(text, pick("bb", "Authorization: Bearer ", "bearer ", "X-Auth-Token: ", "credential ")), F.lit(" ")),
        (0, cut(h("y"), size("z", 32, 40, 64)), F.concat(text, pick("k", "commit ", "sha1: ", "md5 = ", "checksum: ", "sha256:", "revision ", "digest=", "etag: ")), F.lit(" ")),
        (0, cut(digits, size("z", 16, 16, 16, 18, 20)), F.concat(text, pick("k", "", "", "", "card ", "order ", "invoice ", "phone ", "account ")), pick("a", " ", ". ", " the ", ", ")),
        (0, F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12)), F.concat(text, pick("k", "uuid ", "id ", "guid: ", "trace ", "")), F.lit(" ")),
        (0, F.concat(word("w1"), pick("j", "-", "_", "/"), word("w2"), pick("j", "-", "_", "/"), word("w3"), pick("j", "-", "_", "/"), cut(digits, size("z", 1, 2, 4))), F.concat(text, pick("k", "https://example.org/", "/static/", "see ", "www.site.net/", "file ")), pick("a", ".html", "/index", " ", ".png")),
        (0, F.concat(F.initcap(word("w1")), F.initcap(word("w2")), F.initcap(word("w3")), cut(digits, size("z", 1, 2))), F.concat(text, pick("k", "class ", "call ", "new ", "token = ", "key: ")), pick("a", "(", " ", ".", "\n")),
        (0, F.concat(pick("pl", "xxxxxxxxxxxxxxx", "your_token_here_", "000000000000000", "EXAMPLEEXAMPLE", "changeme_changeme", "1234567890123456"), cut(digits, size("z", 1, 2, 3))), F.concat(text, setter), quote),
        (0, F.concat_ws("-", F.lit("20").cast("string"), cut(digits, F.lit(2)), F.substring(digits, 3, 2), F.substring(digits, 5, 6)), F.concat(text, pick("k", "", "version ", "on ", "build ")), F.lit(" ")),
    ]
    k = F.pmod(F.xxhash64(i, F.lit("kind")), F.lit(len(kinds)))
    choose = lambda col: F.coalesce(*[F.when(k == j, F.lit(x[col]) if isinstance(x[col], int) else x[col]) for j, x in enumerate(kinds)])
    return spark.range(0, rows, 1, 1).select(choose(1).alias("value"), choose(2).alias("before"), choose(3).alias("after"), choose(0).cast("double").alias("label"))


def train(findings: DataFrame, trees: int = 40, depth: int = 9) -> PipelineModel:
    """A forest fitted on labelled findings (value, before, after, label); their number is bounded by what reviewers can label."""
    rows = featurise(findings.na.fill("", ["value", "before", "after"])).select(*FEATURES, "label").coalesce(1)
    gather = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=7, probabilityCol="probability").fit(gather.transform(rows))
    return PipelineModel([gather, forest])


def _scored(docs: DataFrame, model: PipelineModel, text_col: str, id_col: str) -> DataFrame:
    scored = model.transform(featurise(candidates(docs, text_col, id_col)))
    return scored.select(id_col, "start", "value", vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, value, score, is_secret): every candidate with its verdict.

    Null and empty texts have none; repeated rows and repeated values are each
    reported; a null id is reported as null.
    """
    found = _scored(docs, model, text_col, id_col)
    return found.select(F.col(id_col).cast("long").alias("doc_id"), "start", F.length("value").cast("long").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with every found secret replaced by MASK and n_chars, where there is one, made to fit; all rows stay.

    Candidates go by their places; one whose value is a secret elsewhere in the
    text goes too, and a longer word that only holds the value stays. Texts without candidates are passed on as they are; only the others meet
    their findings in a join. Rows are told apart by id and whole text, so
    repeated rows and null ids are right too.
    """
    has = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    some = docs.filter(has).withColumn("__mark", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")), 256))
    values = _scored(some, model, "text", "__mark").groupBy("__mark", "value").agg(F.max("score").alias("score"), F.collect_set("start").alias("starts")).filter(F.col("score") >= threshold)
    each = F.transform("starts", lambda at: F.struct(at.alias("start"), F.length("value").alias("length")))
    places = values.groupBy("__mark").agg(F.sort_array(F.flatten(F.collect_list(each)), asc=False).alias("__places"))
    joined = some.join(places, "__mark", "left")
    # from the last place to the first, so that those ahead stay where they are
    mask = lambda t, p: F.concat(F.substring(t, F.lit(1), p["start"].cast("int")), F.lit(MASK), F.substring(t, (p["start"] + p["length"] + 1).cast("int"), F.length(t)))
    masked = joined.withColumn("text", F.when(F.col("__places").isNull(), F.col("text")).otherwise(F.aggregate("__places", F.col("text"), mask)))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__places").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return docs.filter(~has).unionByName(masked.select(docs.columns))


def op4_secrets(docs: DataFrame) -> DataFrame:
    """The digest: every candidate by place, its hash instead of itself, and the forest's verdict."""
    found = scan(docs, train(labelled_findings(docs.sparkSession)))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
