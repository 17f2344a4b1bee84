"""Claims and the conflicts between them.

``extract`` turns texts into atomic claims. ``detect`` is a blocked self-join: rule conflicts
need a common entity, so claims meet on the entities they name (lower case), each pair once.
Rules are tried in order and the first that holds names the edge, as one expression of the plan. What
rules compare is read once a class of claims alike in all that rules read, before classes meet (``slots``); the edge of
two classes is that of their members, whatever their number. Classes that differ only in their letters and numbers are of one kind: rules look at pairs
of kinds, and what is left of pairs of classes, likeness and ratios, are matrices of blocks of them (``meeting``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entities, jaccard, ngrams, sentences, where_any, years
from ..scratch import saved
from .meeting import BLOCK, MET, meeting
from .retrieval import batched
from .similarity import LEAST, alike, sets_alike
from .slots import DATED, RATIO, SEVERE, UNATTRIBUTED, VALUE_ATTRIBUTES, differs, number_tokens, numeric_ratio, profiled, same_qualifiers, same_slot, same_time, slot_parts

# Words by which claims are classified.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
RELATIVE = "yesterday|today|tomorrow|last week|next week|last month|next month|last year|next year"
NUMERICAL = ("increase", "decrease", "percent", "rate", "ratio")
TEMPORAL = ("before", "after", "during", "since", "until", "when")
CAUSAL = ("because", "due to", "caused", "led to", "resulted in", "reason")
DEFINITIONAL = ("defined as", "refers to")
UNCERTAIN = ("uncertain", "likely")
COMPARATIVE = ("more", "less", "better", "worse", "compared", "versus", "than")
SPECULATIVE = ("might", "maybe", "perhaps", "possibly", "arguably")
NEGATION = r"\b(not|no|never|cannot|false|incorrect|denies|denied)\b"
BROAD, NARROW = ("所有", "全部", "all "), ("仅", "只", "某些", "特定", "部分", "only ", "some ")
CAUSE = ("导致", "引起", "造成", "促使", "推动", "使", "因为", "由于", "所以", "causes", "leads to", "results in", "drives", "due to", "because")
NO_CAUSE = ("无关", "无关的", "不影响", "没有关系", "不导致", "并非", "不意味着", "no link", "unrelated", "no effect", "does not cause", "not because")
NEGATED = (
    (" is ", " is not "), (" are ", " are not "), (" was ", " was not "), (" has ", " has no "), (" can ", " cannot "), ("有", "没有"), ("是", "不是"), ("会", "不会"),
)
CONTRADICTED = (
    ("是", "不是"), ("有", "没有"), ("会", "不会"), ("能", "不能"), ("应该", "不应该"), ("可以", "不可以"), ("需要", "不需要"), ("正确", "错误"), ("通过", "搁置"), ("已获通过", "搁置"), ("生效", "搁置"),
    ("上升", "下降"), ("增加", "减少"), ("增长", "下降"), (" is ", " is not "), (" are ", " are not "), (" was ", " was not "), (" has ", " has no "), (" can ", " cannot "), (" will ", " will not "),
    ("increased", "decreased"), ("rose", "fell"),
)
ORDERED = (("之前", "之后"), ("前", "后"), ("before", "after"), ("earlier", "later"))
#: An evidence text that sets its own claims against each other; and one that compares its own numbers.
SETS_APART = (
    "误解", "质疑", "澄清", "不再代表", "并不代表", "不同", "相比", "仅从", "但", "而", "低于", "高于", "more than", "less than", "对比", "比较", " vs ", "vs", "versus", "questioned", "unlike",
)
COMPARES = (
    "低于", "高于", "超过", "少于", "多于", "相比", "比较", "对比", "质疑", "修正", "澄清", "原计划", "推迟", "延误", "延期", "less than", "more than", "lower than", "higher than",
)
REPORTING = ("有报道称", "报道称", "有消息称", "消息称", "部分自媒体声称", "媒体声称", "媒体报道称", "该报道称", "声称")
CORRECTING = ("实际上", "事实上", "但", "不过", "然而", "——")
CORRECTED = ("实际上", "正确", "错误", "并非", "不是")
LESS_OR_MORE = "低于|高于|少于|多于"
ESTIMATES = ("估计", "测算", "预测", "达到", "为", "约")
INHERITS = ("该公司", "公司", "本公司", "该法案", "该研究", "本研究", "本文", "该报告", "报告指出", "报道称", "消息称")
EDGES = " ：:，,。；;"

SUPPORT_SHARED = 0.6


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether ``text`` has one of ``words``; one that holds another of them need not be looked for."""
    least = [w for w in words if not any(o in w for o in words if o != w)]
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in least])


def times(text: Column) -> Column:
    """Years, month names and relative expressions, in that order. Words are looked for before patterns that name them, which try each at every place."""
    return F.concat(
        years(text),
        where_any(text, any_of(text, MONTHS.split("|")), F.regexp_extract_all(text, F.lit(rf"\b({MONTHS})\b"), F.lit(1))),
        where_any(text, any_of(F.lower(text), RELATIVE.split("|")), F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({RELATIVE})\b"), F.lit(1)), F.lower)),
    )


def claim_type(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(text.rlike("[0-9]") & any_of(low, NUMERICAL), "numerical")
        .when(any_of(low, TEMPORAL) & (F.size(times(text)) > 0), "temporal")
        .when(any_of(low, CAUSAL), "causal")
        .when(any_of(low, DEFINITIONAL), "definitional")
        .when(any_of(low, UNCERTAIN), "uncertainty")
        .when(any_of(low, COMPARATIVE), "comparative")
        .otherwise("factual")
    )


def verifiable(text: Column, found_numbers: Column, found_entities: Column) -> Column:
    return (F.size(found_numbers) > 0) | (F.size(found_entities) > 0) | ~any_of(F.lower(text), SPECULATIVE)


def support_type(found_numbers: Column, found_entities: Column, found_times: Column) -> Column:
    factual, named = (F.size(found_numbers) > 0) | (F.size(found_times) > 0), F.size(found_entities) > 0
    return F.when(factual & named, "direct").when(factual | named, "indirect").otherwise("none")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^[{EDGES}]+", ""), f"[{EDGES}]+$", "")


def reported(sentence: Column) -> Column:
    """What a sentence only reports, up to where it turns; null without it."""
    found = _stripped(F.regexp_extract(sentence, f"(?:{'|'.join(REPORTING)})(.+?)(?:，|,|这是|这也是|但|不过|然而|——|$)", 1))
    return F.when(any_of(sentence, REPORTING) & (F.length(found) >= 6), found)


def corrected(sentence: Column) -> Column:
    """What a sentence sets against it: the text after the first turning word that does not only say it is wrong."""
    tails = F.array(*[F.when(F.contains(sentence, F.lit(w)), _stripped(F.regexp_replace(sentence, f"(?s)^.*?{w}", ""))) for w in CORRECTING])
    tail = F.get(F.filter(tails, lambda t: t.isNotNull() & ~t.rlike("错误|不准确|误读|不实")), F.lit(0))
    return F.when(F.length(tail) >= 8, tail)


def compared(sentence: Column) -> Column:
    """The two sides of a compact comparison of estimates, or an empty array."""
    sides = F.transform(F.split(sentence, f"[，,]?\\s*(?:略)?(?:{LESS_OR_MORE})\\s*", 2), _stripped)
    left, right = F.get(sides, F.lit(0)), F.get(sides, F.lit(1))
    number = "(?<![A-Za-z])[0-9]"
    both = (F.length(left) >= 8) & (F.length(right) >= 6) & left.rlike(number) & right.rlike(number) & any_of(sentence, ESTIMATES)
    return F.when(any_of(sentence, LESS_OR_MORE.split("|")) & both, F.array(left, right)).otherwise(F.array().cast("array<string>"))


def resolved(text: Column, names: Column) -> Column:
    """Stand-ins for a law or a company replaced by the first name that is no bare acronym."""
    anchor = F.coalesce(F.get(F.filter(names, lambda n: ~n.rlike("^[A-Z]{2,}(-[A-Z0-9]+)?$")), F.lit(0)), F.get(names, F.lit(0)))
    plain = F.replace(F.replace(F.replace(text, F.lit("该法案"), anchor), F.lit("该公司"), anchor), F.lit("该报道称"), F.lit(""))
    return F.when(anchor.isNull(), text).otherwise(F.trim(F.when(plain.startswith("法案"), F.concat(anchor, F.substr(plain, F.lit(3)))).otherwise(plain)))


def extract(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per sentence of ten characters or more, and per claim that a sentence reports, corrects or compares; ids from their place.

    A sentence that speaks of "the company" or "the study" has the entities of its whole text as well, and so have the claims within it; no other
    sentence carries them. Sentences are split in the generator itself: Spark filters on the size of a generator's column, which splits twice.
    """
    body = F.col(text)
    of_text = texts.select(
        key,
        body.alias("whole"),
        F.when(any_of(body, INHERITS), entities(body)).alias("of_text"),
        any_of(body, SETS_APART).alias("sets_apart"),
        any_of(body, COMPARES).alias("compares"),
        (reported(body).isNotNull() & any_of(body, (*CORRECTED, *CORRECTING))).alias("corrects"),
    )
    lent = lambda s: F.when(F.col("of_text").isNotNull() & any_of(s, INHERITS), F.col("of_text"))
    split = F.transform(sentences(F.col("whole")), lambda s: F.struct(s.alias("sentence"), lent(s).alias("lent")))
    parts = of_text.select("*", F.posexplode(split).alias("place", "part")).select("*", "part.*").drop("whole", "of_text", "part")
    s = F.col("sentence")
    parts = parts.withColumn("names", F.array_distinct(F.concat(entities(s), F.coalesce("lent", F.array().cast("array<string>"))))).drop("lent")
    span = lambda claim, name: F.struct(claim.alias("claim"), F.lit(name).alias("span"))
    sides = compared(s)
    inner = F.array(
        span(s, "sentence"),
        span(resolved(reported(s), F.col("names")), "reported_claim"),
        span(F.when(reported(s).isNotNull(), resolved(corrected(s), F.col("names"))), "corrective_claim"),
        span(F.get(sides, F.lit(0)), "comparative_subject_claim"),
        span(F.get(sides, F.lit(1)), "comparative_reference_claim"),
    )
    several = any_of(s, (*REPORTING, *LESS_OR_MORE.split("|")))
    listed = F.when(several, F.filter(inner, lambda x: x["claim"].isNotNull())).otherwise(F.array(span(s, "sentence")))
    rows = parts.select("*", F.posexplode(listed).alias("inner", "found")).select("*", "found.*")
    c = F.col("claim")
    rows = rows.select(
        F.concat_ws("#", F.col(key), F.concat(F.col("place"), F.when(F.col("inner") > 0, F.concat(F.lit("."), F.col("inner"))).otherwise(F.lit("")))).alias("claim_id"),
        F.col(key).alias("evidence_id"),
        "claim",
        "span",
        F.when(F.col("inner") == 0, F.col("names")).otherwise(F.array_distinct(F.concat(entities(c), F.col("names")))).alias("entities"),
        number_tokens(c).alias("numbers"),
        times(c).alias("times"),
        claim_type(c).alias("claim_type"),
        "sets_apart",
        "compares",
        ((F.col("span") == "reported_claim") & F.col("corrects")).alias("corrected"),
    )
    return rows.withColumns({"verifiable": verifiable(c, F.col("numbers"), F.col("entities")), "support_type": support_type(F.col("numbers"), F.col("entities"), F.col("times"))})


def definition(text: Column) -> Column:
    """What follows ``defined as`` or ``refers to``, to the end of its clause; null without one."""
    found = F.trim(F.regexp_extract(text, r"(?:defined as|refers to)\s+([^.;,]+)", 1))
    return F.when(found != "", found)


def reach(text: Column) -> Column:
    """How wide a claim reaches: global, regional or narrow."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(global|worldwide|everywhere)\b"), "global").when(low.rlike(r"\b(region|regional|national|country)\b"), "regional").when(low.rlike(r"\b(local|only|some|single)\b"), "narrow")


def grain(text: Column) -> Column:
    """How fine a claim measures: fine or coarse."""
    low = F.lower(text)
    return F.when(low.rlike(r"\b(daily|hourly|monthly|per day|per month)\b"), "fine").when(low.rlike(r"\b(yearly|annual|annually|decade|overall)\b"), "coarse")


def _edge(kind: str, confidence: Column | float, severity: Column | str) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(F.lit(kind).alias("conflict_type"), as_column(confidence).cast("double").alias("confidence"), as_column(severity).alias("severity"))


def scope_rule(x: str = "x", y: str = "y") -> Column:
    """Off unless asked for: the claims' reach differs."""
    return F.when(reach(F.col(f"{x}.claim")) != reach(F.col(f"{y}.claim")), _edge("scope_conflict", 0.65, "medium"))


def grain_rule(x: str = "x", y: str = "y") -> Column:
    """Off unless asked for: one claim measures finer."""
    return F.when(grain(F.col(f"{x}.claim")) != grain(F.col(f"{y}.claim")), _edge("granularity_conflict", 0.5, "low"))


def source_rule(x: str = "x", y: str = "y") -> Column:
    """Off unless asked for: sources two ranks apart, and a negation. Claims have a ``source_rank``."""
    negated = F.lower(f"{x}.claim").rlike(NEGATION) != F.lower(f"{y}.claim").rlike(NEGATION)
    return F.when((F.abs(F.col(f"{x}.source_rank") - F.col(f"{y}.source_rank")) >= 2) & negated, _edge("source_conflict", 0.55, "medium"))


OPTIONAL = {"scope": scope_rule, "grain": grain_rule, "source": source_rule}


def self_refuting(claims: DataFrame) -> DataFrame:
    """Claims that take back what they report: an edge from a claim to itself."""
    low = F.lower("claim")
    hit = low.rlike(r"\b(claimed|reported|said|alleged)\b.*\bbut\b.*\b(actually|in fact|false|not true|incorrect)\b")
    return claims.filter(hit).select(F.col("claim_id").alias("source_id"), F.col("claim_id").alias("target_id"), F.lit("refute").alias("conflict_type"), F.lit(0.72).alias("confidence"), F.lit("high").alias("severity"))


def focused(edges: DataFrame, claims: DataFrame, question: str) -> DataFrame:
    """Edges of which an end names an entity or a year of the question; all of them where it names none."""
    asked = F.array_union(F.transform(entities(F.lit(question)), F.lower), years(F.lit(question)))
    about = claims.select("claim_id", F.arrays_overlap(F.concat(F.transform("entities", F.lower), "times"), asked).alias("hit"))
    ends = edges.join(about.withColumnsRenamed({"claim_id": "source_id", "hit": "s"}), "source_id", "left").join(about.withColumnsRenamed({"claim_id": "target_id", "hit": "t"}), "target_id", "left")
    return ends.filter(F.col("s") | F.col("t") | (F.size(asked) == 0)).select(*edges.columns)


def _opposed(x: Column, y: Column) -> Column:
    """Whether one text has the first and the other the second word of a pair (``_sides``)."""
    return F.arrays_overlap(x["one"], y["other"]) | F.arrays_overlap(x["other"], y["one"])


def _sides(pairs_: tuple[tuple[str, str], ...], has: Callable[[Column], Column]) -> Column:
    """struct(one, other): the places of ``pairs_`` of which a text has the first and the second word."""
    side = lambda k: F.filter(F.sequence(F.lit(0), F.lit(len(pairs_) - 1)), lambda i: has(F.get(F.array(*[F.lit(p[k]) for p in pairs_]), i)))
    return F.struct(side(0).alias("one"), side(1).alias("other"))


def worded(low: Column) -> dict[str, Column]:
    """What rules read of the words of a claim, read once a claim."""
    within = lambda w: F.contains(low, w)
    return {
        "negated": _sides(NEGATED, within),
        "contradicted": _sides(CONTRADICTED, within),
        "ordered": _sides(ORDERED, lambda w: F.exists("times", lambda t: F.contains(F.lower(t), w))),
        **{name: any_of(low, words) for name, words in (("broad", BROAD), ("narrow", NARROW), ("cause", CAUSE), ("no_cause", NO_CAUSE))},
        "defined": definition(low),
    }


def _numeric(ratio: Column) -> Column:
    return F.when(ratio.isNotNull(), _edge("numeric_conflict", F.least(F.lit(0.9), 0.5 + (ratio - RATIO) / 2), F.when(ratio > SEVERE, "high").otherwise("medium")))


def _support(similarity: Column) -> Column:
    return F.when(similarity >= SUPPORT_SHARED, _edge("support", F.round(F.least(F.lit(0.95), similarity), 3), "low"))


def _conditions(optional: tuple[str, ...], x: str = "x", y: str = "y") -> dict[str, Column]:
    """What rules ask of a pair of prepared claims, whatever their numbers and their likeness. Only ``forth`` and ``back`` depend on which comes first."""
    of = lambda name: (F.col(f"{x}.{name}"), F.col(f"{y}.{name}"))
    either = lambda a, b: (F.col(f"{x}.{a}") & F.col(f"{y}.{b}")) | (F.col(f"{x}.{b}") & F.col(f"{y}.{a}"))
    values = F.arrays_overlap(F.array_intersect(f"{x}.attributes", f"{y}.attributes"), F.array(*map(F.lit, VALUE_ATTRIBUTES)))
    apart = (F.size(F.array_except(f"{x}.entities", f"{y}.entities")) > 0) & (F.size(F.array_except(f"{y}.entities", f"{x}.entities")) > 0)
    dated = reduce(
        lambda a, b: a | b,
        [
            F.array_contains(f"{x}.attributes", n) & F.array_contains(f"{y}.attributes", n)
            & (F.size(f"{x}.{n}_in") > 0) & (F.size(f"{y}.{n}_in") > 0) & ~F.arrays_overlap(f"{x}.{n}_in", f"{y}.{n}_in")
            for n in DATED
        ],
    )
    first, second = of("ordered")
    return {
        **slot_parts(x, y),
        "mismatch": apart & values,
        "negated": _opposed(*of("negated")),
        "dated": dated,
        "forth": F.arrays_overlap(first["one"], second["other"]),
        "back": F.arrays_overlap(second["one"], first["other"]),
        "scope": either("broad", "narrow"),
        "causal": either("cause", "no_cause"),
        "defined": F.col(f"{x}.defined") != F.col(f"{y}.defined"),
        "contradicted": _opposed(*of("contradicted")),
        **{f"optional_{name}": OPTIONAL[name](x, y) for name in optional},
    }


def _between(optional: tuple[str, ...], c: dict[str, Column], alike: Column, ordered: str = "forth") -> Column:
    """The edge that holds by ``_conditions``, whatever the numbers; null without one."""
    slot = same_slot(c, alike)
    extra = {name: c[f"optional_{name}"] if name in optional else F.lit(None) for name in OPTIONAL}
    return F.coalesce(
        F.when(c["mismatch"] & slot & c["timed"], _edge("entity_mismatch", 0.7, "medium")),
        F.when(c["negated"], _edge("entity_mismatch", 0.8, "high")),
        F.when(c["dated"] & slot, _edge("temporal_conflict", 0.7, "medium")),
        F.when(c[ordered], _edge("temporal_conflict", 0.6, "medium")),
        F.when(c["scope"] & slot & c["timed"], _edge("scope_conflict", 0.75, "high")),
        extra["scope"],
        F.when(c["causal"] & slot, _edge("causal_conflict", 0.6, "high")),
        extra["grain"],
        F.when(c["defined"], _edge("definitional_conflict", 0.6, "medium")),
        extra["source"],
        F.when(c["contradicted"] & slot & c["timed"], _edge("refute", 0.75, "high")),
    )


def rules(optional: tuple[str, ...] = (), x: str = "x", y: str = "y") -> Column:
    """struct(conflict_type, confidence, severity) of the first rule that holds for a pair of prepared claims that share an entity, or null."""
    similarity, c = F.col("similarity"), _conditions(optional, x, y)
    alike = similarity >= UNATTRIBUTED
    together = F.col(f"{x}.evidence_id") == F.col(f"{y}.evidence_id")
    contrast = together & F.col(f"{x}.compares") & same_time(x, y) & same_qualifiers(x, y) & differs(x, y)
    ratio = F.when(same_slot(c, alike) & c["timed"], numeric_ratio(x, y))
    return F.coalesce(F.when(contrast, _edge("numeric_conflict", 0.78, "high")), _numeric(ratio), _between(optional, c, alike), _support(similarity))


def explicit(x: str = "x", y: str = "y") -> Column:
    """Whether two claims of one evidence are set against each other by it."""
    cx, cy = F.col(f"{x}.low"), F.col(f"{y}.low")
    spans = lambda a, b: (F.col(f"{x}.span") == a) & (F.col(f"{y}.span") == b)
    scope = (any_of(cx, BROAD) & any_of(cy, NARROW)) | (any_of(cy, BROAD) & any_of(cx, NARROW))
    numbers = (F.size(f"{x}.numbers") > 0) & (F.size(f"{y}.numbers") > 0)
    told = spans("reported_claim", "corrective_claim") | spans("corrective_claim", "reported_claim")
    return told | (F.col(f"{x}.sets_apart") & (F.arrays_overlap(f"{x}.attributes", f"{y}.attributes") | numbers | scope))


def _known(claims: DataFrame) -> DataFrame:
    """What a text says of its own claims is false where it is not known."""
    known = {"span": F.lit("sentence"), **{c: F.lit(False) for c in ("sets_apart", "compares", "corrected")}}
    return claims.withColumns({c: v for c, v in {**known, "times": F.array().cast("array<string>")}.items() if c not in claims.columns})


def _read(claims: DataFrame) -> DataFrame:
    """Profiles of claims, but for the letters of their texts."""
    keys = F.array_sort(F.array_distinct(F.transform("entities", F.lower)))
    return profiled(_known(claims)).withColumns({"keys": keys, **worded(F.col("low"))})


def prepared(claims: DataFrame) -> DataFrame:
    """Profiles of claims, written once: with all they are made of in one plan with the rules, the optimizer may not end."""
    return saved(_read(claims).withColumn("grams", ngrams(F.col("low"), 2)), "prepared")


def pairs(claims: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y) of prepared claims that share an entity, each once and the smaller id first; with ``others``, pairs of one of either.

    A pair that shares several entities is kept under the first of them only, so no pass removes duplicates.
    Claims of one evidence meet only where it sets them against each other; one that its own evidence corrects meets no other evidence.
    """
    left = claims.select(F.explode("keys").alias("entity"), F.struct(*claims.columns).alias("x"))
    right = claims if others is None else others
    right = right.select(F.explode("keys").alias("entity"), F.struct(*claims.columns).alias("y"))
    met = left.join(right, "entity").filter("x.claim_id < y.claim_id" if others is None else "x.claim_id <> y.claim_id")
    met = met.filter(F.col("entity") == F.array_min(F.array_intersect("x.keys", "y.keys")))
    first = F.col("x.claim_id") < F.col("y.claim_id")
    met = met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("x"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("y"))
    apart = F.col("x.evidence_id") != F.col("y.evidence_id")
    return met.filter((apart & ~F.col("x.corrected") & ~F.col("y.corrected")) | (~apart & explicit()))


def _edges(met: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    scored = met.withColumn("similarity", jaccard(F.col("x.grams"), F.col("y.grams")))
    edges = scored.select(F.col("x.claim_id").alias("source_id"), F.col("y.claim_id").alias("target_id"), rules(optional).alias("edge"))
    return edges.filter("edge is not null").select("source_id", "target_id", "edge.*")


#: All that rules read of a claim, but for its ids.
READ = ("claim", "entities", "numbers", "times", "span", "sets_apart", "compares", "corrected", "source_rank")


def classed(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of claims that no rule can tell apart (c, READ, n members and their first and last id), and members (claim_id, evidence_id, c)."""
    rows = _known(claims).filter("claim_id is not null and evidence_id is not null")
    read = [c for c in READ if c in rows.columns]
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("claim_id", "evidence_id", *read).repartition(parts, "claim_id")  # claims may come from a file of few parts
    rows = rows.withColumn("digest", F.sha2(F.to_json(F.struct(*read)), 256))
    own = [F.min("claim_id").alias("first"), F.max("claim_id").alias("last"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in read]]
    classes = saved(rows.groupBy("digest").agg(*own).withColumn("c", F.monotonically_increasing_id()), "classes")
    return classes, saved(rows.select("claim_id", "evidence_id", "digest").join(classes.select("digest", "c"), "digest").drop("digest"), "members")


#: What rules read of a claim besides its letters and numbers.
KIND = (
    "entities", "negated", "contradicted", "ordered", "broad", "narrow", "cause", "no_cause", "defined",
    "attributes", "time_keys", "revenue", "sales", "emissions", "aims_temperature", "aims_qubits", "contrasts", *(f"{n}_in" for n in DATED),
)
#: Of claims, if optional rules are asked for.
KIND_OPTIONAL = ("claim", "source_rank")


def class_edges(classes: DataFrame, optional: tuple[str, ...] = (), types: tuple[str, ...] | None = None, crowded: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """(c, d, n, edge): the edge of a member of class c and one of class d with a larger id and other evidence, for all classes that have such members by their ids; of ``types`` only, if given.

    With ``crowded`` (c), classes of which a member shares its evidence with another claim, edges of others come as sums where they can (``meeting``): c and d are null, n are the pairs of members.
    Rules look at pairs of kinds that share an entity; the classes of a kind are dealt to blocks, and a task gets pairs of blocks.
    """
    rows = _read(classes).filter("not corrected")
    own = [c for c in (*KIND, *(KIND_OPTIONAL if optional else ())) if c in rows.columns]
    rows = rows.select("c", "first", "last", "n", "low", "quantities", "keys", *own, F.sha2(F.to_json(F.struct(*own)), 256).alias("kind"))
    if crowded is not None:
        rows = rows.join(crowded.withColumn("crowded", F.lit(True)), "c", "left").withColumn("lone", F.col("crowded").isNull()).drop("crowded")
    else:
        rows = rows.withColumn("lone", F.lit(False))
    rows = saved(rows, "profiles")
    kinds = saved(rows.groupBy("kind").agg(F.count("*").alias("size"), *[F.first(c).alias(c) for c in ("keys", *own)]), "kinds")

    side = lambda x: kinds.select(F.explode("keys").alias("entity"), F.struct(*kinds.columns).alias(x))
    met = side("x").join(side("y"), "entity").filter("x.kind <= y.kind")
    met = met.filter(F.col("entity") == F.array_min(F.array_intersect("x.keys", "y.keys")))
    blocks = lambda x: F.ceil(F.col(f"{x}.size") / BLOCK).cast("int")
    asked = _conditions(optional)
    met = met.select(F.col("x.kind").alias("x"), F.col("y.kind").alias("y"), blocks("x").alias("of_x"), blocks("y").alias("of_y"), *[c.alias(f"is_{k}") for k, c in asked.items()])
    told = {k: F.col(f"is_{k}") for k in asked}
    outcome = {"same": F.col("x") == F.col("y")}
    for i, alike_ in enumerate((F.lit(False), F.lit(True))):
        outcome[f"num{i}"] = F.coalesce(same_slot(told, alike_) & told["timed"], F.lit(False))
        outcome[f"xy{i}"], outcome[f"yx{i}"] = (_between(optional, told, alike_, way) for way in ("forth", "back"))
    pairs_ = met.select("x", "y", "of_x", "of_y", *[c.alias(k) for k, c in outcome.items()])
    pairs_ = pairs_.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of_x") - 1)))
    pairs_ = pairs_.withColumn("j", F.explode(F.sequence(F.when(F.col("same"), F.col("i")).otherwise(0), F.col("of_y") - 1)))
    pairs_ = pairs_.withColumn("same", F.col("same") & (F.col("i") == F.col("j")))

    large = kinds.filter(F.col("size") > BLOCK).select("kind", "size")
    rows = rows.select("kind", F.struct("c", "first", "last", "n", "lone", "low", "quantities").alias("row"))
    if large.isEmpty():
        rows = rows.withColumn("block", F.lit(0))
    else:
        number = F.pmod(F.xxhash64("row.c"), F.ceil(F.col("size") / BLOCK)).cast("int")
        rows = rows.join(large, "kind", "left").withColumn("block", F.coalesce(number, F.lit(0)))
    dealt = rows.groupBy("kind", "block").agg(F.collect_list("row").alias("rows"))
    of = lambda x, i: dealt.select(F.col("kind").alias(x), F.col("block").alias(i), F.col("rows").alias(f"{x}s"))
    both = pairs_.join(of("x", "i"), ["x", "i"]).join(of("y", "j"), ["y", "j"])
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "x", "i", "y", "j").select("same", "num0", "num1", "xy0", "yx0", "xy1", "yx1", "xs", "ys")
    found = batched(both).mapInArrow(meeting(types, SUPPORT_SHARED, crowded is not None, unique), MET)
    return found.select("c", "d", "n", F.coalesce("edge", _numeric(F.col("ratio")), _support(F.col("similarity"))).alias("edge"))


def _expanded(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``edges`` (c, d, ...) of classes as those of their members, the smaller id first."""
    a, b = members.select("c", F.col("claim_id").alias("source_id"), F.col("evidence_id").alias("e")), members.select(F.col("c").alias("d"), F.col("claim_id").alias("target_id"), F.col("evidence_id").alias("f"))
    return edges.join(a, "c").join(b, "d").filter("source_id < target_id and e <> f").drop("c", "d", "e", "f")


def _several(members: DataFrame) -> DataFrame:
    """Evidence with more claims than one."""
    return members.groupBy("evidence_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("evidence_id")


def _single(claims: DataFrame, several: DataFrame, optional: tuple[str, ...]) -> DataFrame:
    """Edges between claims of one evidence, where it sets them against each other, and of claims that refute themselves."""
    if several.isEmpty():  # spares a plan as large as that of all rules
        return self_refuting(claims)
    rows = prepared(claims.join(several, "evidence_id", "left_semi"))
    side = lambda x: rows.select("evidence_id", F.explode("keys").alias("entity"), F.struct(*rows.columns).alias(x))
    met = side("x").join(side("y"), ["evidence_id", "entity"]).filter("x.claim_id < y.claim_id")
    met = met.filter(F.col("entity") == F.array_min(F.array_intersect("x.keys", "y.keys"))).filter(explicit())
    return _edges(met, optional).unionByName(self_refuting(claims))


def detect(claims: DataFrame, optional: tuple[str, ...] = (), types: tuple[str, ...] | None = None) -> DataFrame:
    """(source_id, target_id, conflict_type, confidence, severity) of all rule edges between claims, and of claims that refute themselves; of ``types`` only, if given.

    Classes meet; only their edges are made those of members, by two joins of ids.
    """
    classes, members = classed(claims)
    apart = _expanded(class_edges(classes, optional, types).select("c", "d", "edge.*"), members)
    single = _single(claims, _several(members), optional)
    return apart.unionByName(single if types is None else single.filter(F.col("conflict_type").isin(*types)))


def summed(claims: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """(conflict_type, severity, n, confidence): how many edges ``detect`` finds and their mean confidence, without making those of members.

    Two classes have as many edges as pairs of members, less those of one evidence. Only where an edge depends on which of
    two claims has the smaller id, or ids are not unique, are members looked at.
    """
    classes, members = classed(claims)
    shared = saved(_several(members), "several")
    crowded = members.join(shared, "evidence_id", "left_semi").select("c").distinct()
    twice = members.groupBy("claim_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    found = saved(class_edges(classes, optional, crowded=crowded, unique=twice), "edges")
    edges = found.filter("c is not null").select("c", "d", "edge")
    sizes = classes.select("c", "first", "last", "n")
    low, high = F.least("c", "d").alias("p"), F.greatest("c", "d").alias("q")
    both = edges.groupBy(low, high).agg(F.count("*").alias("ways"), F.count_distinct("edge").alias("kinds"), F.min("c").alias("c"), F.min("edge").alias("edge"))
    one, two = (sizes.select(*[F.col(c).alias(f"{s}_{c}") for c in sizes.columns]) for s in "pq")
    both = both.join(one, F.col("p") == F.col("p_c")).join(two, F.col("q") == F.col("q_c"))
    ordered = (F.col("p_last") < F.col("q_first")) | (F.col("q_last") < F.col("p_first"))
    whole = ((F.col("p") == F.col("q")) | ordered | ((F.col("ways") == 2) & (F.col("kinds") == 1))) & F.lit(twice)
    both = saved(both.withColumn("whole", whole), "pairs")
    every = both.filter("whole").select("p", "q", "edge", F.when(F.col("p") == F.col("q"), F.expr("p_n * (p_n - 1) div 2")).otherwise(F.col("p_n") * F.col("q_n")).alias("n"))
    by = members.groupBy("c", "evidence_id").agg(F.count("*").alias("m"))
    side = lambda x, m: by.select(F.col("c").alias(x), "evidence_id", F.col("m").alias(m))
    inside = every.join(side("p", "pm").join(shared, "evidence_id", "left_semi"), "p").join(side("q", "qm"), ["q", "evidence_id"])
    inside = inside.select("edge", (-F.when(F.col("p") == F.col("q"), F.expr("pm * (pm - 1) div 2")).otherwise(F.col("pm") * F.col("qm"))).alias("n"))
    split = both.filter("not whole").select("p", "q")
    rest = _expanded(edges.join(split, (F.least("c", "d") == F.col("p")) & (F.greatest("c", "d") == F.col("q")), "left_semi"), members).select("edge")
    loose = _single(claims, shared, optional).select(F.struct("conflict_type", "confidence", "severity").alias("edge")).unionByName(rest)
    rows = found.filter("c is null").select("edge", "n").unionByName(every.select("edge", "n")).unionByName(inside).unionByName(loose.select("edge", F.lit(1).cast("long").alias("n")))
    counts = rows.groupBy("edge").agg(F.sum("n").alias("n")).filter("n > 0").select("edge.*", "n")
    mean = F.sum(F.col("confidence") * F.col("n")) / F.sum("n")
    return counts.groupBy("conflict_type", "severity").agg(F.sum("n").alias("n"), mean.alias("confidence"))


def support_apart(claims: DataFrame, least: float = LEAST, blocks: bool = True) -> DataFrame:
    """Support between claims of different evidence that share no entity but nearly all of their text; claims of one text are support too.

    Pairs are found by their bigrams (``similarity``); with ``blocks``, their likeness is by matching blocks where that is larger.
    """
    rows = claims.select("claim_id", "evidence_id", F.lower("claim").alias("low"), F.transform("entities", F.lower).alias("keys"))
    found = (alike if blocks else sets_alike)(rows, "claim_id", "low", least=least)
    side = lambda x: rows.select(F.col("claim_id").alias(x), F.struct("evidence_id", "keys").alias(f"of_{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b").filter("of_a.evidence_id <> of_b.evidence_id").filter(~F.arrays_overlap("of_a.keys", "of_b.keys"))
    edge = _edge("support", F.round(F.least(F.lit(0.95), F.col("similarity")), 3), "low")
    return both.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), edge.alias("edge")).select("source_id", "target_id", "edge.*")


def grow(known: DataFrame, fresh: DataFrame, edges: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Edges that ``fresh`` claims add to those there are: new with new and new with known, none twice. Known claims do not meet each other again."""
    new = prepared(fresh)
    met = pairs(new).unionByName(pairs(new, prepared(known)))
    found = _edges(met, optional).unionByName(self_refuting(fresh))
    return found.join(edges.select("source_id", "target_id", "conflict_type"), ["source_id", "target_id", "conflict_type"], "left_anti")


def conflict_ratio(edges: DataFrame) -> DataFrame:
    conflicts = F.count_if(F.col("conflict_type") != "support")
    return edges.agg(conflicts.alias("conflicts"), F.count_if(F.col("conflict_type") == "support").alias("supports"), (conflicts / F.count("*")).alias("ratio"))
