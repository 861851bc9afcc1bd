"""Markdown nodes, key-value lines, paths and number formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .repair import let
from .text import strip

#: Numbers of the block kinds.
BLOCK_TYPES = {"text": 2, "heading1": 3, "heading2": 4, "heading3": 5, "bullet": 12, "ordered": 13, "code": 14, "quote": 15}
#: Line prefixes of the kinds.
PREFIXES = {"## ": "heading1", "### ": "heading2", "#### ": "heading3", "> ": "quote", "- ": "bullet"}
#: Endings and first folders by which a text counts as a local path.
PATH_ENDINGS = [".json", ".jsonl", ".yaml", ".yml", ".txt", ".png", ".jpg", ".jpeg", ".md", ".safetensors", ".bin", ".pt", ".pth", ".jinja"]
PATH_FOLDERS = ["configs", "data", "models", "outputs", "reports", "runs", "tools", "logs", ".cache", "cache"]
#: How an image and a line of a key with its value are written.
IMAGE = r"^!\[(.*?)\]\((.*?)\)$"
KEY_VALUE = r"^\s*([^:=#]+?)\s*[:=]\s*(.*?)\s*$"
FENCE_LINE = r"(?m)^[ \t]*```[^\n]*$"
LINE_END = r"\r\n|[\n\r]"


def _node(line: Column) -> Column:
    x = strip(line)
    node = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    source = strip(F.regexp_extract(x, IMAGE, 2))
    alt = strip(F.regexp_extract(x, IMAGE, 1))
    caption = F.coalesce(F.nullif(alt, F.lit("")), F.substring_index(source, "/", -1))
    out = F.when(x == "", None).when(x.rlike(IMAGE), node("quote", F.concat(F.lit("Image: "), caption, F.lit(" (local path: "), source, F.lit(")")))).when(x.startswith("# "), None)
    for prefix, kind in PREFIXES.items():
        out = out.when(x.startswith(prefix), node(kind, strip(F.substr(x, F.lit(len(prefix) + 1)))))
    return out.when(x.rlike(r"^[0-9]+\.\s+"), node("ordered", strip(F.regexp_replace(x, r"^[0-9]+\.\s+", "")))).otherwise(node("text", x))


def markdown_nodes(text: Column) -> Column:
    """Nodes (kind, text) of a Markdown text in order. Lines of three backticks toggle code, whose lines are one node; an unclosed block
    counts unless it has no line. Blank lines and titles give no node, images a quote. The fences cut the text into parts that alternate, so no state runs over lines."""

    def part(p: Column, i: Column) -> Column:
        body = F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^\n", ""))
        code = F.struct(F.lit("code").alias("kind"), F.regexp_replace(F.regexp_replace(body, r"\n$", ""), r"(?m)[ \t]+$", "").alias("text"))
        plain = F.filter(F.transform(F.split(body, "\n"), _node), lambda n: n.isNotNull())
        return F.when(i % 2 == 0, plain).otherwise(F.array(code))

    def nodes(parts: Column) -> Column:
        shown = F.filter(parts, lambda p, i: (i % 2 == 0) | (i < F.size(parts) - 1) | (F.regexp_replace(p, r"^\n", "") != ""))
        return F.flatten(F.transform(shown, part))

    return let(F.split(F.regexp_replace(text, LINE_END, "\n"), FENCE_LINE), nodes)


def markdown_title(text: Column) -> Column:
    """The last title outside fences; null if there is none."""
    outside = F.filter(F.split(F.regexp_replace(text, LINE_END, "\n"), FENCE_LINE), lambda p, i: i % 2 == 0)
    titles = F.filter(F.flatten(F.transform(outside, lambda p: F.transform(F.split(p, "\n"), strip))), lambda x: x.startswith("# "))
    return strip(F.substr(F.try_element_at(titles, F.lit(-1)), F.lit(3)))


def block_type(kind: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in BLOCK_TYPES.items() for x in pair]), kind)


def block(node: Column) -> Column:
    """The block of a node: its number, its kind, one run of text; code is wrapped."""
    text = F.array(F.struct(F.struct(node["text"].alias("content")).alias("text_run")))
    return F.struct(block_type(node["kind"]).alias("block_type"), node["kind"].alias("kind"), text.alias("elements"), (node["kind"] == "code").alias("wrap"))


def chunks(blocks: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, chunk, blocks (in order): what one request of a sink carries. Groups have at most `size` rows."""
    got = blocks.groupBy("doc_id", F.floor(F.col("node_no") / size).cast("bigint").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("node_no", "block"))).alias("b"))
    return got.select("doc_id", "chunk", F.transform("b", lambda x: x["block"]).alias("blocks"))


def key_values(text: Column) -> Column:
    """map of the lines `key = value` or `key: value`; blanks and lines of `#` do not count, quotes around values go, the last of equal keys wins."""
    lines = F.filter(F.split(text, LINE_END), lambda x: (strip(x) != "") & ~strip(x).startswith("#") & x.rlike(KEY_VALUE))
    unquoted = lambda v: F.regexp_replace(F.regexp_replace(v, r'^"+|"+$', ""), r"^'+|'+$", "")
    pairs = F.reverse(F.transform(lines, lambda x: F.struct(strip(F.regexp_extract(x, KEY_VALUE, 1)).alias("k"), unquoted(strip(F.regexp_extract(x, KEY_VALUE, 2))).alias("v"))))
    return let(pairs, lambda p: let(F.array_distinct(F.transform(p, lambda x: x["k"])), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.get(F.filter(p, lambda x: x["k"] == k), F.lit(0))["v"]))))


def looks_like_path(value: Column) -> Column:
    """Whether a text is meant as a local path: no web address, and absolute, dotted, with a slash, of a known ending or first folder."""
    url = value.startswith("http://") | value.startswith("https://")
    ending = value.rlike("(" + "|".join(e.replace(".", r"\.") for e in PATH_ENDINGS) + r")\z")
    return ~url & (value.startswith(".") | F.contains(value, F.lit("/")) | F.contains(value, F.lit("\\")) | ending | F.substring_index(value, "/", 1).isin(PATH_FOLDERS))


def percent(x: Column) -> Column:
    """One decimal and a sign; `-` for null."""
    return F.coalesce(F.format_string("%.1f%%", x * 100), F.lit("-"))


def number(x: Column, places: int = 4) -> Column:
    return F.coalesce(F.format_string(f"%.{places}f", x), F.lit("-"))
