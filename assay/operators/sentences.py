"""Sentences ranked against a question: its terms of several lengths, and marks of figures and of what the question asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stripped

# Words that are no terms, marks of approximate figures, and the words by which questions of penalties are known and answered.
STOP = ("多少", "如何", "什么", "是否", "是不是", "对吗", "已经", "这个", "那个", "具体", "精确", "准确", "确切")
APPROXIMATE = ("约", "大约", "左右", "接近", "近", "超过", "不足", "多于", "少于", "around", "about", "approximately")
PENALTY = ("罚款", "处罚", "上限", "营业额", "fine", "penalty")
PENALTY_SAID = ("欧元", "turnover")
OTHER = ("生效", "适用", "风险等级", "分类", "规则")
OTHER_BUT = ("罚款", "处罚", "上限", "营业额", "欧元")
ENDS = "。！？!?；;"
WIDEST = 6
FIGURE, ROUGHLY, ASKED, BESIDE = 0.25, 0.25, 6.0, -4.0


def terms(question: Column) -> Column:
    """Words of two letters or more, and of runs of Chinese characters all pieces of two to six; each once, in lower case, without STOP."""
    runs = F.regexp_extract_all(question, F.lit(r"[A-Za-z0-9]+|[一-鿿]{2,}"), F.lit(0))
    widths = lambda t: F.sequence(F.lit(2), F.least(F.lit(WIDEST), F.length(t)))
    pieces = lambda t: F.flatten(F.transform(widths(t), lambda w: F.transform(F.sequence(F.lit(1), F.length(t) - w + 1), lambda i: F.substr(t, i, w))))
    each = F.transform(runs, lambda t: F.when(t.rlike("^[一-鿿]"), pieces(t)).when(F.length(t) >= 2, F.array(F.lower(t))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.flatten(each)), lambda t: ~t.isin(*STOP))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def attribute_score(question: Column, sentence: Column) -> Column:
    """Six for a sentence on penalties where the question asks for one, four less for one on when and to whom a rule applies."""
    asked, low = _any(F.lower(question), PENALTY), F.lower(sentence)
    good = F.when(_any(low, (*PENALTY, *PENALTY_SAID)), ASKED).otherwise(0.0)
    bad = F.when(_any(low, OTHER) & ~_any(low, OTHER_BUT), BESIDE).otherwise(0.0)
    return F.when(asked, good + bad).otherwise(0.0)


def split(text: Column) -> Column:
    """Sentences with the marks that end them; a full stop of Latin script ends none."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+"), F.lit(0)), stripped), lambda s: s != "")


def ranked(questions: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, doc_id, place, score, sentence): the best sentences of each question's evidence.

    ``questions`` (query_id, question), ``evidence`` (query_id, doc_id, rank, title, text). Sentences that score nothing are left out; of equal scores
    the better evidence counts, then the earlier sentence. A title is a sentence of its own.
    """
    if limit < 1:
        raise ValueError("limit is at least one")
    asked = questions.select("query_id", "question", terms(F.col("question")).alias("terms"))
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit("。"), F.coalesce("text", F.lit("")))
    said = evidence.select("query_id", "doc_id", F.col("rank").alias("of"), F.posexplode(split(whole)).alias("place", "sentence")).filter(F.col("sentence") != "。")
    low = F.lower("sentence")
    hits = F.aggregate("terms", F.lit(0.0), lambda n, t: n + F.contains(low, t).cast("double"))
    score = hits + attribute_score(F.col("question"), F.col("sentence")) + F.when(F.col("sentence").rlike("[0-9]"), FIGURE).otherwise(0.0) + F.when(_any(low, APPROXIMATE), ROUGHLY).otherwise(0.0)
    rows = said.join(asked, "query_id").withColumn("score", score).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "of", "doc_id", "place")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "place", "score", "sentence")
