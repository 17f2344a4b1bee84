"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of every script; ``\\w`` would be ASCII only here.
TOKEN = r"[\p{L}\p{N}_]+"
#: Articles that answer normalisation drops.
ARTICLES = ("a", "an", "the")


def tokens(text: Column) -> Column:
    """Lower-case word tokens; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def answer_tokens(text: Column) -> Column:
    """Tokens of a normalised answer: lower case, punctuation as space, no articles."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda t: (t != "") & ~t.isin(*ARTICLES))


def normal_answer(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def squeezed(text: Column) -> Column:
    """Lower case, trimmed, inner white space collapsed: the key of exact dedup."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def alnum(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-character substrings; a shorter text is one gram, an empty one has none.

    A look-ahead matches at every position without cutting the string from its start each time; the full stop takes a pair of surrogates as one.
    """
    every = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(F.length(text) >= n, every).when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def where_any(text: Column, marked: Column, found: Column) -> Column:
    """The array ``found`` where ``marked``, a quick test that holds wherever it has members; else an empty one, or null for null."""
    return F.when(marked, found).when(text.isNotNull(), F.array().cast("array<string>"))


def years(text: Column) -> Column:
    return where_any(text, text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])"), F.lit(0)))


def entities(text: Column) -> Column:
    """Capitalised words and runs of them, and acronyms, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?=[A-Z])\b[A-Z][A-Za-z0-9#]+(?: [A-Z][A-Za-z0-9#]+)*"), F.lit(0)))


def stripped(text: Column) -> Column:
    """Without white space of any kind at its ends.

    The pattern tries every blank, trimming only the ends; they differ where a line end of another kind comes last, as ``$`` holds before it.
    """
    other = text.endswith("\u0085") | text.endswith("\u2028") | text.endswith("\u2029")
    return F.when(other, F.regexp_replace(text, r"^\s+|\s+$", "")).otherwise(F.btrim(text, F.lit(" \t\n\x0b\f\r")))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences of at least ``least`` characters, which is one or more. A full stop between digits ends none.

    A line end is set after each and the text split there: one character is split at without a pattern, and a pattern that looks behind tries every place.
    """
    lines = F.regexp_replace(text, "[.!?。！？](?![0-9])", "$0\n")
    return F.filter(F.transform(F.split(lines, "\n"), stripped), lambda s: F.length(s) >= least)


def citations(text: Column) -> Column:
    """Evidence ids in square brackets."""
    return F.regexp_extract_all(text, F.lit(r"\[([A-Za-z][A-Za-z0-9_-]*)\]"), F.lit(1))


# Endings of names written in Chinese characters, what may stand before one, and names of products within such text.
NAME_ENDINGS = ("法案", "公司", "科技", "集团", "大学", "研究院", "委员会", "理事会", "模型", "系统", "市场", "电池", "芯片", "制程", "算法", "平台", "销量", "营收", "敏感度", "霸权")
NAME_LEADS = (
    "近日有消息称", "另有报道称", "近日", "另有", "根据", "关于", "针对", "对于", "其中", "该", "其", "对", "在", "和", "与", "但", "另外", "实际上", "有报道称", "截至", "部分自媒体声称", "媒体声称", "消息称", "有消息称", "报道称", "声称",
)
PRODUCTS = ("AI", "ECS", "3nm", "5nm", "GPT", "GPU", "CPU")
SHORT_NAMES = {"欧盟AI法案": "AI法案"}
SAME_NAMES = {"人工智能": "AI"}
_INSIDE, _BEFORE = r"[\p{L}\p{N}_]", r"(?<![\p{L}\p{N}_])"
_HAN = r"一-鿿"


def trimmed_name(name: Column) -> Column:
    """A name without what leads to it and what follows its ending; of several endings the first of the list counts."""
    plain = stripped(F.regexp_replace(name, f"^({'|'.join(NAME_LEADS)})", ""))
    out = F.when(F.lit(False), "")
    for ending in NAME_ENDINGS:
        out = out.when(F.contains(plain, F.lit(ending)), F.concat(F.substring_index(plain, ending, 1), F.lit(ending)))
    cut = out.otherwise(F.lit(None).cast("string"))
    for long, short in SAME_NAMES.items():
        cut = F.replace(cut, F.lit(long), F.lit(short))
    return F.coalesce(cut, plain)


def _variants(names: Column) -> Column:
    return F.flatten(F.transform(names, lambda n: F.coalesce(*[F.when(n == long, F.array(n, F.lit(short))) for long, short in SHORT_NAMES.items()], F.array(n))))


def names(text: Column) -> Column:
    """Names of any script, each once: capitalised words, acronyms, phrases of Chinese characters with an ending of NAME_ENDINGS, and those around a product."""
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    capitals = every(rf"{_BEFORE}(?:[A-Z][a-z]+|[A-Z]{{2,}}[A-Z0-9]*(?:-[A-Z0-9]+)?)(?!{_INSIDE})")
    acronyms = every(r"(?<![A-Za-z])[A-Z]{2,}[A-Z0-9]*(?![A-Za-z])")
    ended = every(rf"(?:^|[，。；：、\s（(])([{_HAN}A-Za-z0-9·-]{{2,24}}?(?:{'|'.join(NAME_ENDINGS)}))", 1)
    mixed = every(rf"[{_HAN}]{{1,12}}(?:{'|'.join(PRODUCTS)})[{_HAN}A-Za-z0-9-]{{0,8}}")
    ended = F.filter(F.transform(ended, trimmed_name), lambda n: F.length(n) >= 2)
    return F.array_distinct(F.concat(capitals, acronyms, _variants(ended), _variants(F.transform(mixed, trimmed_name))))
