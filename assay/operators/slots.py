"""Fact slots: which claims state a value of the same thing.

``profiled`` reads all features of a claim once, before claims meet: attributes, time keys, qualifiers, and its
quantities by unit and context, without the numbers that are part of dates. ``same_slot`` then is an expression over two
profiles: arrays that overlap or not, no text. Claims that share an entity only ("Acme was founded in 2012", "Acme has
3,000 employees") are not in one slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import where_any

# The words by which claims are told to be about an attribute, a qualifier, a period or a unit.
ATTRIBUTES = {
    "revenue": "营收 收入 revenue",
    "profit": "利润 profit",
    "sales": "销量 销售 交付 sales deliveries delivered",
    "employees": "员工 人数 employees",
    "founded": "成立 创立 founded",
    "founder": "创始人 创办人 founder",
    "strategy": "策略 路线 模式 特点 strategy roadmap",
    "timeline": "关键节点 历程 演变 timeline",
    "passed": "通过 批准 搁置 已获通过 passed approved",
    "effective": "生效 effective",
    "ban": "禁止 ban",
    "allow": "允许 allow",
    "climate_sensitivity": "气候敏感度 最佳估计 climate_sensitivity ecs",
    "estimate": "估计 estimate",
    "size": "规模 尺寸 size",
    "growth": "增长 growth",
    "decline": "下降 decline",
    "ratio": "比例",
    "temperature": "温度",
    "emissions": "排放 emissions",
    "process_node": "制程 栅极长度 物理尺寸 物理栅极长度 命名",
    "market_share": "市场份额 market_share",
    "runtime": "计算任务 计算时间 经典算法 耗时 runtime",
    "funding": "融资",
    "valuation": "估值 valuation",
    "fine": "罚款 营业额 fine penalty turnover",
    "qubits": "量子比特 qubit qubits",
    "ranking": "排名 ranking",
    "headquarters": "总部 headquarters",
    "ceo": "首席执行官 ceo",
    "capital": "首都 capital",
}
#: ``passed`` is not meant where the word is part of these.
NOT_PASSED = ("通过的.{0,12}(等级|分类|版本|规则|条款|框架)", "通过(部门|统一|法律|规章|框架|规则)")
VALUE_ATTRIBUTES = ("capital", "headquarters", "ceo")
REVENUE = {"cloud": "云服务", "ai_chip": "AI芯片", "enterprise_software": "企业软件", "other_business": "其他业务", "rd_spend": "研发投入"}
SALES = {
    "global": "全球 global", "china": "中国 china", "europe": "欧洲 europe", "us": "美国 u.s. us", "export": "出口 海外市场 export overseas", "manufacturer": "制造商 车企 manufacturer",
}
EMISSIONS = {
    "fossil_fuel": "化石燃料 fossil", "land_use": "土地利用 land_use", "coal": "煤炭 coal", "oil": "石油 oil", "gas": "天然气 gas", "china": "中国", "us": "美国", "eu": "欧盟", "india": "印度",
}
#: Words after which a date is that of the attribute, clause by clause.
DATED = {"effective": "生效 适用 effective take_effect", "founded": "成立 创立 founded", "passed": "通过 批准 获通过 approved passed 搁置"}
CLAUSE = "[，,；;。]|而且|并且|同时|不过|然而"
ROLES = ("manufacturer", "export")
ANNUAL = ("全年", "年度", "财年", "annual", "yearly")
#: What a text has that names a year or a quarter; looked for before the patterns.
CENTURIES, QUARTER = ("19", "20"), ("Q", "q", "季度")
QUARTERS = {"1": "1一", "2": "2二", "3": "3三", "4": "4四"}
TARGET_TEMPERATURE = ("目标", "以内", "控制在", "减排")
TARGET_QUBITS = ("需要", "至少", "目标", "预计", "计划", "required", "target")
CONTRAST = ("与{}不同", "和{}不同", "不同于{}", "unlike {}")
UNITS = "°C|℃|年|月|日|天|小时|分钟|秒|万美元|亿元|欧元|美元|元|亿|万|nm|纳米|厘米|公里|km|米|吨|个|量子比特|qubits?|FLOPS|%"
NUMBER = rf"(?<![A-Za-z])[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?%?\s*(?:{UNITS})?"
#: A token with more than digits, of which alone no unit is named.
MARKED = r"[^0-9.,\s]"
UNIT_CLASSES = (
    ("percent", "%|percent"), ("money", "元|\\$|€"), ("magnitude", "万|亿"), ("temperature", "°c|℃|摄氏度"), ("length", "nm|纳米|厘米|米|km|公里"),
    ("duration", "秒|分钟|小时|天|年"), ("qubit", "量子比特|qubit"),
)
NODES = "制程|工艺|命名|节点|级芯片|及以下|先进|量产"

RATIO, SEVERE = 1.1, 1.5
#: Least text similarity of claims without a common attribute, where one has none.
UNATTRIBUTED = 0.55


def _has(text: Column, words: str | tuple[str, ...], apart: str | None = " ") -> Column:
    out = F.lit(False)
    for w in words.split(apart) if isinstance(words, str) else words:
        out = out | F.contains(text, F.lit(w.replace("_", " ")))
    return out


def _named(text: Column, table: dict[str, str]) -> Column:
    """The names of ``table`` of which a word is in ``text``."""
    return F.filter(F.array(*[F.when(_has(text, words), F.lit(name)) for name, words in table.items()]), lambda x: x.isNotNull())


def attributes(text: Column, low: Column | None = None) -> Column:
    """``low``: the text in lower case, where it is there."""
    low = F.lower(text) if low is None else low
    not_passed = F.lit(False)
    for pattern in NOT_PASSED:
        not_passed = not_passed | low.rlike(pattern)
    return F.filter(_named(low, ATTRIBUTES), lambda a: (a != "passed") | ~not_passed)


def time_keys(text: Column) -> Column:
    """Years, quarters and the annual period that a claim names, as ``year:2020``, ``quarter:3``, ``period:annual``."""
    years = where_any(text, _has(text, CENTURIES), F.regexp_extract_all(text, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1)))
    found = F.transform(years, lambda y: F.concat(F.lit("year:"), y))
    quarters = F.array(*[F.when(text.rlike(f"[Qq]{q}(?![0-9])|第?[{marks}]季度"), F.lit(f"quarter:{q}")) for q, marks in QUARTERS.items()])
    annual = F.when(_has(text, ANNUAL), F.array(F.lit("period:annual"))).otherwise(F.array().cast("array<string>"))
    named = where_any(text, _has(text, QUARTER), F.filter(quarters, lambda x: x.isNotNull()))
    return F.array_distinct(F.concat(found, named, annual))


def number_tokens(text: Column) -> Column:
    """Numbers with their units, as written."""
    return where_any(text, text.rlike("[0-9]"), F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda t: F.trim(t)))


def value(token: Column) -> Column:
    """The number of a token, times 10,000 or 100,000,000 where it says so."""
    plain = F.regexp_extract(F.replace(token, F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0).cast("double")
    return plain * F.when(F.contains(token, F.lit("亿")), 1e8).when(F.contains(token, F.lit("万")), 1e4).otherwise(1.0)


def unit_class(token: Column) -> Column:
    low = F.lower(token)
    out = F.when(~token.rlike(MARKED), "plain")
    for name, pattern in UNIT_CLASSES:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("plain")


def units_agree(a: Column, b: Column) -> Column:
    return (a == b) | ((a != "percent") & (b != "percent") & ((a == "plain") | (b == "plain")))


def context_class(token: Column, text: Column) -> Column:
    """What a number of this unit is of: a process node named in nanometres is no length."""
    low = F.lower(token)
    at = F.call_function("locate", low, F.lower(text))
    window = F.substr(text, F.greatest(F.lit(1), at - 16), F.length(token) + 18 + F.least(at - 1, F.lit(16)))
    after = F.substr(text, at + F.length(token), F.lit(18))
    marked = token.rlike(MARKED)
    return (
        F.when(marked & low.rlike("秒|分钟|小时|天|年"), "duration")
        .when(marked & low.rlike("%|percent"), "percentage")
        .when(marked & low.rlike(r"元|\$|€"), "money")
        .when(at == 0, "quantity")
        .when(after.rlike(r"^\s*(秒|分钟|小时|天|年)"), "duration")
        .when(after.rlike(r"(?i)^(\s*个?(物理|逻辑)?量子比特|\s*qubit)"), "qubits")
        .when(F.substr(text, F.greatest(F.lit(1), at - 5), F.least(at - 1, F.lit(5))).rlike(r"距离(为|是|=)?\s*$"), "code_distance")
        .when(low.rlike("nm|纳米") & window.rlike(NODES), "process_node")
        .otherwise("quantity")
    )


def of_date(token: Column, text: Column) -> Column:
    """Whether a number is a year, part of a date or range of dates, or the number of a quarter."""
    digits = F.regexp_replace(token, "[^0-9]", "")
    whole = F.floor(F.regexp_replace(token, "[^0-9.]", "").try_cast("double"))
    day = token.rlike(r"[0-9]\s*[月日]")
    dated = lambda pattern: F.call_function("regexp_like", text, pattern)
    span = (digits != "") & F.contains(text, F.lit("月")) & dated(F.concat(F.lit("(?<![0-9])"), digits, F.lit(r"\s*[-–至到]\s*[0-9]{1,2}\s*月")))
    quarter = digits.isin("1", "2", "3", "4") & dated(F.concat(F.lit("[Qq]"), digits, F.lit("|第?"), digits, F.lit("季度")))
    return F.coalesce(whole.between(1800, 2099), F.lit(False)) | day | span | quarter


def quantities(tokens: Column, text: Column) -> Column:
    """struct(value, unit, context) of the numbers that are no part of a date."""
    kept = F.filter(tokens, lambda t: t.rlike("[0-9]") & ~of_date(t, text))
    return F.transform(kept, lambda t: F.struct(value(t).alias("value"), unit_class(t).alias("unit"), context_class(t, text).alias("context")))


def dates_of(text: Column, words: str) -> Column:
    """Years of the clauses that have one of ``words``, or of a short clause right before where those have none."""
    years = lambda t: F.regexp_extract_all(t, F.lit(r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])"), F.lit(1))
    none = F.array().cast("array<string>")
    clauses = F.filter(F.transform(F.split(text, CLAUSE), lambda t: F.trim(t)), lambda c: c != "")

    def of(c: Column, i: Column) -> Column:
        before = F.get(clauses, i - 1)
        own = F.when(F.size(years(c)) > 0, years(c)).when(F.length(before) <= 40, years(before)).otherwise(none)
        return F.when(_has(c, words), own).otherwise(none)

    return where_any(text, _has(text, words), F.array_distinct(F.flatten(F.transform(clauses, of))))


def profiled(claims: DataFrame) -> DataFrame:
    """``claims`` (claim, entities, numbers, ...) with the features that slots compare."""
    claims = claims.withColumn("low", F.lower("claim"))  # a step of its own, so that it is made once
    c, low = F.col("claim"), F.col("low")
    contrast = F.filter("entities", lambda e: (e != "") & _exists(low, F.lower(e)))
    return claims.withColumns(
        {
            "attributes": attributes(c, low),
            "time_keys": time_keys(c),
            "quantities": quantities(F.col("numbers"), c),
            "revenue": _named(c, REVENUE),
            "sales": _named(c, SALES),
            "emissions": _named(c, EMISSIONS),
            "aims_temperature": _has(c, TARGET_TEMPERATURE),
            "aims_qubits": _has(low, TARGET_QUBITS),
            "contrasts": contrast,
            **{f"{name}_in": dates_of(c, words) for name, words in DATED.items()},
        }
    )


def _exists(low: Column, entity: Column) -> Column:
    out = F.lit(False)
    for pattern in CONTRAST:
        before, _, after = pattern.partition("{}")
        out = out | F.contains(low, F.concat(F.lit(before), entity, F.lit(after)))
    return out


def same_time(x: str = "x", y: str = "y") -> Column:
    """Years, quarters and periods that both name agree, and no quarter meets a year as a whole."""
    a, b = F.col(f"{x}.time_keys"), F.col(f"{y}.time_keys")
    out = F.lit(True)
    of = lambda keys, prefix: F.filter(keys, lambda k: k.startswith(prefix))
    for prefix in ("year:", "quarter:", "period:"):
        i, j = of(a, prefix), of(b, prefix)
        out = out & ((F.size(i) == 0) | (F.size(j) == 0) | F.arrays_overlap(i, j))
    annual = lambda keys: F.array_contains(keys, "period:annual")
    return out & ~((F.size(of(a, "quarter:")) > 0) & annual(b)) & ~((F.size(of(b, "quarter:")) > 0) & annual(a))


def same_qualifiers(x: str = "x", y: str = "y") -> Column:
    """Claims on revenue, sales or emissions are of one kind of it; targets do not meet what was reached."""
    both = lambda name: F.array_contains(f"{x}.attributes", name) & F.array_contains(f"{y}.attributes", name)
    either = F.array_contains(f"{x}.attributes", "climate_sensitivity") | F.array_contains(f"{y}.attributes", "climate_sensitivity")

    def agree(a: Column, b: Column) -> Column:
        return ((F.size(a) == 0) & (F.size(b) == 0)) | F.arrays_overlap(a, b)

    roles = lambda side: F.array_intersect(f"{side}.sales", F.array(*map(F.lit, ROLES)))
    sold = F.when((F.size(roles(x)) > 0) | (F.size(roles(y)) > 0), F.arrays_overlap(roles(x), roles(y))).otherwise(agree(F.col(f"{x}.sales"), F.col(f"{y}.sales")))
    return (
        (~both("revenue") | agree(F.col(f"{x}.revenue"), F.col(f"{y}.revenue")))
        & (~both("sales") | sold)
        & (~both("emissions") | agree(F.col(f"{x}.emissions"), F.col(f"{y}.emissions")))
        & (~either | (F.col(f"{x}.aims_temperature") == F.col(f"{y}.aims_temperature")))
        & (~both("qubits") | (F.col(f"{x}.aims_qubits") == F.col(f"{y}.aims_qubits")))
    )


def slot_parts(x: str = "x", y: str = "y") -> dict[str, Column]:
    """What tells whether two claims that share an entity state the same kind of fact, but for their likeness: see ``same_slot``."""
    shared = F.array_intersect(f"{x}.entities", f"{y}.entities")
    contrasted = F.arrays_overlap(shared, F.array_union(f"{x}.contrasts", f"{y}.contrasts"))
    return {
        "meets": (F.size(shared) > 0) & ~contrasted & same_qualifiers(x, y),
        "named": (F.size(f"{x}.attributes") > 0) & (F.size(f"{y}.attributes") > 0),
        "common": F.arrays_overlap(f"{x}.attributes", f"{y}.attributes"),
        "timed": same_time(x, y),
    }


def same_slot(parts: dict[str, Column], alike: Column) -> Column:
    """Whether claims are of one slot, whatever their times: a common attribute, or, where one has none, ``alike``: a similarity of UNATTRIBUTED or more."""
    return parts["meets"] & F.when(parts["named"], parts["common"]).otherwise(alike)


def numeric_ratio(x: str = "x", y: str = "y") -> Column:
    """The first ratio beyond RATIO between quantities of one context and of units that agree; null without one."""
    comparable = lambda a, b: (a["context"] == b["context"]) & (a["context"] != "process_node") & units_agree(a["unit"], b["unit"]) & (a["value"] > 0) & (b["value"] > 0)
    each = F.transform(f"{x}.quantities", lambda a: F.transform(f"{y}.quantities", lambda b: F.when(comparable(a, b), F.greatest(a["value"], b["value"]) / F.least(a["value"], b["value"]))))
    return F.get(F.filter(F.flatten(each), lambda r: r > RATIO), F.lit(0))


def differs(x: str = "x", y: str = "y") -> Column:
    """Whether any two quantities of units that agree are 5% apart or more."""
    gap = lambda a, b: F.abs(a["value"] - b["value"]) / F.greatest(a["value"], b["value"], F.lit(1.0))
    return F.exists(f"{x}.quantities", lambda a: F.exists(f"{y}.quantities", lambda b: units_agree(a["unit"], b["unit"]) & (gap(a, b) >= 0.05)))
