"""Removal of lines that recur across documents, also with variable fields: a log-template tree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import unused_names
from hostlens.operators.sizing import broadcast_if_small
from hostlens.session import cut

LEAD = 3  # depth of the tree below the token count: leading tokens
LEAST_FAMILIES = 10
CHUNK_WORDS = 4  # words in a row by which a family is told
# constant words of a template, to its words (tokens that are no plain numbers), at least, ...
SIMILAR = (3, 4)
CONSTANT = (2, 5)  # ... and to all its tokens
# scripts without blanks: there numbers are tokens of their own
BLANK_FREE = r"[\x{0E00}-\x{0EFF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"
FIELD = "<*>"
KEY_CHARS = 16


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _key(text: Column) -> Column:
    return F.left(F.md5(text), F.lit(KEY_CHARS))


def _masked(token: Column) -> Column:
    """A token with a digit is a variable field."""
    return F.when(token.rlike("[0-9]"), FIELD).otherwise(token)


def _spaced(line: Column) -> Column:
    """The line with blanks around the numbers in scripts that have none."""
    apart = F.regexp_replace(line, f"({BLANK_FREE})([0-9])", "$1 $2")
    return F.when(line.rlike(BLANK_FREE), F.regexp_replace(
        apart, f"([0-9])({BLANK_FREE})", "$1 $2")).otherwise(line)


def _lead(line: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.split(line, " ", LEAD + 1), 1, LEAD), _masked), " ")


def _leaf(line: Column) -> Column:
    tokens = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    return F.concat_ws(" ", tokens.cast("string"), _lead(line))


def _least_chunk(line: Column) -> Column:
    """The smallest key of CHUNK_WORDS words in a row, the line being cut into such rows."""
    chunk = rf"[^ ]++(?: ++[^ ]++){{0,{CHUNK_WORDS - 1}}}"
    return F.array_min(F.transform(F.regexp_extract_all(line, F.lit(chunk), F.lit(0)), _key))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, leaf, line_hash, family) of every line that isn't blank.

    A leaf of the tree is a number of tokens (pieces between blanks; in scripts without
    blanks also numbers) and the first LEAD of them, with fields masked. The family of a line stands for the rest of its document: the
    smallest key of CHUNK_WORDS words in a row of the lines that differ from it. Copies and
    most near copies of a document have the same, so they don't make their lines recur. A
    document without other lines is a family by its own text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"),
        _key(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    rows = rows.withColumn("drawn", F.transform("lines", lambda line: F.when(
        line.rlike(r"\S"), F.struct(_least_chunk(line).alias("h"), line.alias("line")))))
    rows = rows.withColumn("top", F.array_min("drawn"))
    rows = rows.withColumn("second", F.coalesce(F.array_min(F.filter(
        "drawn", lambda d: d["line"] != F.col("top.line")))["h"], F.col("text_key")))
    each = rows.select("doc_id", "text_hash", "top", "second",
                       F.posexplode("lines").alias("at", "line"))
    line = F.col("line")
    each = each.filter(line.rlike(r"\S")).withColumn("spaced", _spaced(line))
    return each.select(
        "doc_id", "text_hash", "at", _leaf(F.col("spaced")).alias("leaf"),
        F.xxhash64(line).alias("line_hash"),
        F.when(line == F.col("top.line"), F.col("second")).otherwise(F.col("top.h"))
        .alias("family"))


def _recurring(lines: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Keys that enough families have; more copies of a document never take a key out."""
    return lines.groupBy(*keys).agg(F.countDistinct("family").alias("families")).filter(
        F.col("families") >= least).select(*keys)


def recurring_lines(docs: DataFrame, least: int = LEAST_FAMILIES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, at, template) of every line that recurs.

    A line, a leaf or a template recurs if `least` families have it, however many copies come
    along. A line that recurs as it is is its own template. In other leaves that recur, a
    token without digits is constant at its place if `least` families of the leaf have it
    there; all others are fields. A line's template is its constants and fields. It counts if
    its constants are a share of SIMILAR of its words (tokens that are no plain numbers) and
    of CONSTANT of all its tokens: so a template may have many numbers but few variable words
    or codes, and a line never goes by the pattern of its numbers or codes alone. Short lines
    are parsed alike.
    """
    lines = cut(split_lines(docs, id_col, text_col), "template-lines")
    leaves = cut(_recurring(lines, ["leaf"], least), "template-leaves")
    leaves = broadcast_if_small(leaves)  # counted; more of them are joined by shuffle
    found = cut(lines.join(leaves, "leaf"), "template-found")
    same = cut(_recurring(found, ["leaf", "line_hash"], least), "template-same")
    varied = cut(found.join(same, ["leaf", "line_hash"], "left_anti"), "template-varied")

    texts = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line"))
    texts = texts.select("line", _spaced(F.col("line")).alias("spaced")).select(
        _leaf(F.col("spaced")).alias("leaf"), "line", "spaced")
    texts = texts.join(leaves, "leaf").distinct().select(
        "leaf", F.xxhash64("line").alias("line_hash"), F.split("spaced", " ").alias("tokens"))
    words = cut(texts.join(same, ["leaf", "line_hash"], "left_anti").select(
        "leaf", "line_hash", F.posexplode("tokens").alias("i", "token")), "template-tokens")
    has_digit = F.col("token").rlike("[0-9]")
    word = ~has_digit | F.col("token").rlike(r"\p{L}")
    constants = (
        words.filter(~has_digit).join(
            varied.select("leaf", "line_hash", "family").distinct(), ["leaf", "line_hash"])
        .groupBy("leaf", "i", "token").agg(F.countDistinct("family").alias("n"))
        .filter(F.col("n") >= least).select("leaf", "i", "token", F.lit(True).alias("constant"))
    )
    parsed = (
        words.join(constants, ["leaf", "i", "token"], "left")
        .groupBy("leaf", "line_hash").agg(
            F.array_sort(F.collect_list(F.struct("i", F.when(F.col("constant"), F.col("token"))
                                                 .otherwise(FIELD).alias("t")))).alias("t"),
            F.count(F.lit(1)).alias("n"), F.count_if(word).alias("words"),
            F.count("constant").alias("fixed"))
        .filter((F.col("fixed") * SIMILAR[1] >= F.col("words") * SIMILAR[0])
                & (F.col("fixed") * CONSTANT[1] >= F.col("n") * CONSTANT[0]))
        .select("leaf", "line_hash", F.array_join("t.t", " ").alias("template"))
    )
    placed = cut(varied.join(parsed, ["leaf", "line_hash"]), "template-parsed")
    wanted = ["doc_id", "text_hash", "at", "template"]
    return placed.join(_recurring(placed, ["template"], least), "template").select(*wanted).unionByName(
        found.join(same, ["leaf", "line_hash"]).select(
            *wanted[:3], F.concat("leaf", F.lit(" "), F.hex("line_hash")).alias("template")))


def drop_recurring_lines(docs: DataFrame, least: int = LEAST_FAMILIES, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows with their recurring lines taken out, and `n_lines`, `n_dropped`.

    Every occurrence goes. A row that loses all its lines stays with an empty text; a null
    text stays null with no lines. Other columns stay, whatever their names, but a column
    named n_lines or n_dropped is replaced. Rows of equal id and text are treated alike.
    Lines of any length are worked off in time proportional to their words.
    """
    own_id, own_hash, gone, lines = unused_names(docs, "id", "hash", "gone", "lines")
    dropped = recurring_lines(docs, least, id_col, text_col).select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), "at").groupBy(
        own_id, own_hash).agg(F.array_sort(F.collect_set("at")).alias(gone))  # at most a text's lines
    kept = [name for name in docs.columns if name not in ("n_lines", "n_dropped")]
    own = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    rows = docs.hint("merge").join(
        dropped, docs[id_col].eqNullSafe(dropped[own_id]) & (own == dropped[own_hash]), "left")
    rows = rows.withColumn(lines, F.split(F.col(text_col), "\n"))
    # the stretches between dropped lines, so that no line is looked up in the list
    ends = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))
    left = _bind(F.struct(F.col(lines).alias("all"), ends.alias("ends")), lambda x: F.array_join(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["ends"]) - 2), lambda k: F.slice(
            x["all"], F.get(x["ends"], k) + 2, F.get(x["ends"], k + 1) - F.get(x["ends"], k) - 1))),
        "\n"))
    return rows.select(
        *[F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(left).alias(name)
          if name == text_col else F.col(name) for name in kept],
        F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias("n_dropped"))
