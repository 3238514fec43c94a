"""Names that stand for others: partly hidden names of companies, banks, courts, addresses, and made-up values by seed."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import amount, compact, stable_seed

#: Endings of companies, of places (both in the order they are tried), regions that stand without an ending, endings of banks.
COMPANY_ENDS = ("集团股份有限公司", "控股股份有限公司", "股份有限公司", "有限责任公司", "集团有限公司", "控股有限公司", "有限公司", "有限合伙", "普通合伙", "分公司", "子公司", "集团", "公司")
PLACE_ENDS = (
    "经济技术开发区", "高新技术产业开发区", "高新技术开发区", "高新区", "开发区", "工业园区", "科技园区", "新区", "街道", "自治区", "自治州", "地区", "园区", "省", "市", "区", "县", "旗", "乡", "镇",
)
REGIONS = (
    "北京", "上海", "天津", "重庆", "广东", "广西", "海南", "河北", "河南", "湖北", "湖南", "江苏", "浙江", "安徽", "福建", "江西", "山东", "山西", "陕西", "四川", "贵州", "云南", "辽宁", "吉林",
    "黑龙江", "甘肃", "青海", "台湾", "内蒙古", "宁夏", "新疆", "西藏", "香港", "澳门", "广州", "深圳",
)
BANK_ENDS = ("支行", "分行", "营业部", "分理处", "信用社", "联社")
STRATEGIES = ("official", "serial_roles", "symbolic_codes")


def strategy(key: Column) -> Column:
    """A known strategy's key; others are the official one."""
    plain = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    return F.when(plain.isin(*STRATEGIES), plain).otherwise(STRATEGIES[0])


def _segments(text: str, least: int = 1) -> list[str]:
    """Places at the beginning of text, one after another: up to 12 ideographs and an ending."""
    out, rest = [], text
    while rest:
        found = next((m for end in PLACE_ENDS if (m := re.match(f"[一-龥]{{{least},12}}{end}", rest))), None)
        if not found:
            break
        out.append(found[0])
        rest = rest[found.end() :]
    return out


def _level(place: str) -> str:
    if place.endswith(("省", "自治区")):
        return "province"
    if place.endswith(("市", "自治州", "地区")):
        return "city"
    return "local" if place.endswith(("区", "县", "旗", "乡", "镇", "街道")) else "other"


def _hidden_place(place: str) -> str:
    end = next((e for e in PLACE_ENDS if place.endswith(e)), "")
    base = place[: len(place) - len(end)]
    if not end or not base:
        return place
    return (f"{base[0]}*{base[2:]}" if len(base) > 1 else "*") + end


def hidden_core(core: str) -> str:
    """The second letter, digit or ideograph as 某; a lone one is followed by it."""
    seen = [i for i, c in enumerate(core) if "一" <= c <= "鿿" or (c.isascii() and c.isalnum())]
    if not core:
        return ""
    if len(seen) > 1:
        return core[: seen[1]] + "某" + core[seen[1] + 1 :]
    at = seen[0] + 1 if seen else len(core)
    return core[:at] + "某" + core[at:]


def _company(text: str) -> tuple[str, str, str]:
    end = next((e for e in COMPANY_ENDS if text.endswith(e)), "")
    base = text[: len(text) - len(end)]
    region = "".join(_segments(base, 2))
    if not region and len(base) > 3:
        region = next((r for r in sorted(REGIONS, key=len, reverse=True) if base.startswith(r) and len(base) > len(r) + 1), "")
    return region, base[len(region) :] or base, end


def _bank(text: str) -> str:
    if not text:
        return ""
    if "银行" in text:
        core, _, rest = text.partition("银行")
        return (hidden_core(core) or "某") + "银行" + rest
    end = next((e for e in BANK_ENDS if text.endswith(e)), "")
    if not end:
        return hidden_core(text)
    base = text[: -len(end)]
    region = "".join(_segments(base, 2))
    core = base[len(region) :] or base
    return region + (hidden_core(core) or "某") + end


def _detail(text: str) -> str:
    for marks, shown in ((("路", "街", "道", "巷"), "某路某号"), (("栋", "室", "房", "铺", "单元"), "某楼某室"), (("村", "组", "社"), "某村某组"), (("号",), "某号")):
        if any(m in text for m in marks):
            return shown
    return "某路某号"


def _address(text: str) -> str:
    if not text:
        return "某市某区某路某号"
    places = _segments(text)
    tail = text[len("".join(places)) :]
    if places:
        local = [i for i, p in enumerate(places) if _level(p) == "local"]
        at = local[-1] if local else len(places) - 1
        places[at] = _hidden_place(places[at])
    return "".join(places) + _detail(tail or text)


def _court(text: str, words: tuple[str, ...]) -> str:
    found = [(text.rfind(w), len(w)) for w in words if w in text]
    if not found:
        return text
    at = max(found)[0]
    before, rest = text[:at], text[at:]
    places = _segments(before)
    if not places:
        return f"某{rest}"
    if len(places) == 1:
        return _hidden_place(places[0]) + before[len(places[0]) :] + rest
    target, city = -1, False
    for i, place in enumerate(places):
        level = _level(place)
        city = city or level in ("province", "city")
        if city and level == "local":
            target = i
    if target < 0:
        return text
    tail = before[len("".join(places)) :]
    places[target] = _hidden_place(places[target])
    return "".join(places) + tail + rest


def _each(rule: Callable[[str], str], value: Column) -> Column:
    """A rule over texts without white space, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else rule("".join(t.split())))

    return run(value)


def company_parts(name: Column) -> Column:
    """struct<region, core, ending> of a company's name."""

    @F.pandas_udf("struct<region:string,core:string,ending:string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_company("".join((t or "").split())) for t in texts], columns=["region", "core", "ending"], dtype=object)

    return run(name)


def bank_alias(name: Column) -> Column:
    return _each(_bank, name)


def address_alias(address: Column) -> Column:
    """Places stay but for the last local one, what follows them becomes a placeholder."""
    return _each(_address, address)


def judicial_alias(name: Column, words: tuple[str, ...] = ("人民法院", "人民检察院", "仲裁委员会")) -> Column:
    """A court's name with its last local place below a city hidden, or its only place."""
    return _each(lambda t: _court(t, words), name)


# --- made-up values, all of a seed ---

CREDIT = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CONTRACT_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"


def _digits(seed: Column, base: int, width: int) -> Column:
    return F.lpad(F.pmod(seed, F.lit(base)).cast("string"), width, "0")


def made_up(kind: Column, text: Column) -> Column:
    """A value of a kind that the text's seed alone decides; null for kinds without a rule."""
    seed = stable_seed(text)
    at = lambda letters, n: F.substr(F.lit(letters), (F.pmod(n, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    check = F.when(F.pmod(seed, F.lit(2)) == 1, "X").otherwise(F.pmod(seed, F.lit(10)).cast("string"))
    identity = F.concat(F.lit("110101"), (F.pmod(seed, F.lit(20)) + 1985).cast("string"), F.lpad((F.pmod(seed, F.lit(12)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(seed, F.lit(28)) + 1).cast("string"), 2, "0"), (F.pmod(seed, F.lit(900)) + 100).cast("string"), check)
    year = F.coalesce(F.nullif(F.regexp_extract(text, "(20[0-9]{2})", 1), F.lit("")), F.lit("2026"))
    contract = F.concat(F.lit("HT["), year, F.lit("]"), at(CONTRACT_LETTERS, seed), at(CONTRACT_LETTERS, F.floor(seed / 3)), (F.pmod(seed, F.lit(9000)) + 1000).cast("string"), F.lit("号"))
    return (
        F.when(kind == "CN_PHONE", F.concat(F.lit("139"), _digits(seed, 10**8, 8)))
        .when(kind == "EMAIL_ADDRESS", F.concat(F.lit("contact"), (F.pmod(seed, F.lit(997)) + 1).cast("string"), F.lit("@example.com")))
        .when(kind == "CN_ID_CARD", identity)
        .when(kind == "CN_CREDIT_CODE", F.concat(*[at(CREDIT, seed + 7 * i) for i in range(18)]))
        .when(kind == "CONTRACT_NO", contract)
        .when(kind == "PROJECT_CODE", F.concat(F.lit("PRJ-"), (F.pmod(seed, F.lit(3)) + 2026).cast("string"), F.lit("-"), F.lpad((F.pmod(seed, F.lit(900)) + 100).cast("string"), 3, "0")))
    )


# --- amounts in words ---

FIGURES, PLACES, GROUPS = "零壹贰叁肆伍陆柒捌玖", ("", "拾", "佰", "仟"), ("", "万", "亿", "兆")
VALUES = {c: n for n, cs in enumerate(("零〇", "一壹", "二贰两", "三叁", "四肆", "五伍", "六陆", "七柒", "八捌", "九玖")) for c in cs}
UNITS = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000, "万": 10**4, "亿": 10**8}


def _upper(value: int) -> str:
    if not value:
        return "零元整"
    out = []
    for group, section in enumerate(reversed([value // 10**at % 10**4 for at in (12, 8, 4, 0)])):
        shown, gap = "", False
        for place, figure in enumerate(reversed(f"{section:04d}")):
            if figure != "0":
                shown = FIGURES[int(figure)] + PLACES[place] + ("零" if gap else "") + shown
                gap = False
            else:
                gap = bool(shown)
        if section:
            out.append(shown + GROUPS[group])
    return re.sub("零+", "零", "".join(reversed(out))).rstrip("零") + "元整"


def _from_words(text: str | None) -> float | None:
    total = section = number = 0
    known = [c for c in text or "" if c in VALUES or c in UNITS]
    for c in known:
        if c in VALUES:
            number = VALUES[c]
        elif UNITS[c] < 10**4:
            section, number = section + max(number, 1) * UNITS[c], 0
        else:
            total, section, number = total + (section + max(number, 1)) * UNITS[c], 0, 0
    return float(total + section + number) or None if known else None


def upper_amount(value: Column) -> Column:
    """A whole number below 10**16 in the capital numerals of amounts."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) else _upper(int(v)) for v in values], dtype=object)

    return run(value.cast("long"))


def amount_in_words(text: Column) -> Column:
    """The number of an amount in numerals of words; null without any. As the rule has it, a group's last figure counts
    before its unit only as far as the section before does."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_from_words(t) for t in texts], dtype="float64")

    return F.nullif(run(text), F.lit(float("nan")))


def amount_value(text: Column) -> Column:
    """The number of an amount in figures, else in words, else 100,000."""
    return F.coalesce(amount(text), amount_in_words(text), F.lit(100000.0))


def person_source(name: Column) -> Column:
    return compact(name)
