"""Text, number and date functions as columns; all stay in the JVM unless their docstring says otherwise."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that never belong to a value.
STRIPPED_MARKS = r"\s:：，,。；;（）()《》【】\"“”'`"
#: Full-width marks and their ASCII forms, in the same order.
FULL_WIDTH = "，。：；（）【】"
HALF_WIDTH = ",.:;()[]"
#: Weights and check digits of the 18-digit identity number (GB 11643) and the credit code (GB 32100).
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
#: Serial characters, the first ten of a series.
SERIALS = "甲乙丙丁戊己庚辛壬癸"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
#: A character of private use, which marks matches in a text.
MARK = "\ue0fe"


def compact(text: Column) -> Column:
    """Without any white space, Unicode's included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def strip_marks(text: Column) -> Column:
    """Without white space and marks."""
    return F.regexp_replace(text, f"(?U)[{STRIPPED_MARKS}]", "")


def normalize(text: Column) -> Column:
    """For comparisons: no white space, full-width marks as ASCII."""
    return F.translate(compact(text), FULL_WIDTH, HALF_WIDTH)


def semantic(text: Column) -> Column:
    """For comparisons of meaning: dates in one form without leading zeros, one zero, lower case, no marks."""
    plain = F.regexp_replace(F.translate(F.lower(normalize(text)), "〇○", "00"), r"([0-9]{4})部(?=[0-9]{1,2}月)", "$1年")
    for pattern in (r"([0-9]{4})年0*([0-9]{1,2})月0*([0-9]{1,2})日", r"([0-9]{4})[-.]0*([0-9]{1,2})[-.]0*([0-9]{1,2})"):
        plain = F.regexp_replace(plain, pattern, "$1/$2/$3")
    return F.regexp_replace(F.translate(plain, "年月日", ""), r"(?U)[^\w]+", "")


def clean_candidate(text: Column, most: int = 120) -> Column:
    """A value as it may be shown: white space collapsed, marks at both ends gone, at most ``most`` characters."""
    one = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.left(F.regexp_replace(one, f"(?U)^[{STRIPPED_MARKS}]+|[{STRIPPED_MARKS}]+$", ""), F.lit(most))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, most + 1 if it is larger."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, F.lit(most + 1)).otherwise(found)


def similarity(a: Column, b: Column, above: Column | None = None, once: bool = False) -> Column:
    """1 if equal; the ratio of lengths if one holds the other; else the matching-blocks ratio, for which texts go to Python
    in Arrow batches: 2 M / T, with the longest common block, then the longest on either side of it, and so on.

    With ``above``, a ratio that is not above it may be given as 0: what can't reach it by its length stays in the JVM, what
    can't by its longest common subsequence has no blocks looked for, and others have as long as what is left could reach it.
    ``once`` keeps conditions on the result from being moved before it, where they would work it out a second time; then the
    column must be used once.
    """

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_alike(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def ratio_above(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series(_all_alike_above(list(left), list(right), list(least)), dtype="float64")

    if above is None:
        return ratio(a, b)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    short = (shorter > 0) & (2.0 * shorter / (shorter + longer) <= above)
    of = ratio_above.asNondeterministic() if once else ratio_above
    return F.when(short, 0.0).otherwise(of(F.when(~short, a), F.when(~short, b), above))


def _alike(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    return SequenceMatcher(None, a, b).ratio()


#: Length of the second text from which difflib leaves frequent characters out of what blocks begin with.
JUNK_FROM = 200
#: Length from which common subsequences are not worked out, whose cost is that of both lengths: characters are only counted.
COUNTED_FROM = 20_000


def _all_alike_above(left: list, right: list, least: list) -> list:
    """_alike of each pair, or 0 where it is not above least: matching blocks are a common subsequence, whose longest length
    is worked out for all pairs of one text together."""
    out, open_, held = [0.0] * len(left), [], SequenceMatcher(None, "", "")
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is None or b is None or not a or not b or a in b or b in a:
            out[i] = _alike(a, b)
        elif max(len(a), len(b)) < COUNTED_FROM:
            open_.append(i)
        else:
            out[i] = _alike_above(a, b, least[i], min(len(a), len(b)), held)
    one, other = (right, left) if len({right[i] for i in open_}) <= len({left[i] for i in open_}) else (left, right)
    groups = defaultdict(list)
    for i in open_:
        groups[one[i]].append(i)
    masks: dict[str, dict] = {}
    for text, members in groups.items():
        for i, n in zip(members, _common([other[i] for i in members], text, masks), strict=True):
            a, b = left[i], right[i]
            if 2.0 * n / (len(a) + len(b)) > least[i]:
                out[i] = _alike_above(a, b, least[i], n, held)
    return out


def _places(text: str) -> dict[str, bytes]:
    """For each character of a text a bit for each of its places, and at least one bit more, for a carry."""
    codes = np.frombuffer((text + "\0").encode("utf-32-le"), "<u4")
    held = {c: np.packbits(codes == ord(c), bitorder="little") for c in set(text)}
    held.get("\0", np.zeros(1, "u1"))[-1] &= (1 << len(text) % 8) - 1
    return {c: bits.tobytes() for c, bits in held.items()}


def _common(texts: list[str], text: str, masks: dict[str, dict[str, bytes]]) -> list[int]:
    """Lengths of the longest common subsequences of each of texts and text: one bit for each character of all texts, a byte
    or more apart, so that a step over text's characters is one sum of long numbers (Hyyrö). masks are those of texts so far."""
    sizes = [len(t) // 8 + 1 for t in texts]
    for t in texts:
        if t not in masks:
            masks[t] = _places(t)
    own = [(masks[t], bytes(n)) for t, n in zip(texts, sizes, strict=True)]
    joined = {c: int.from_bytes(b"".join([m.get(c, zero) for m, zero in own]), "little") for c in set(text)}
    full = int.from_bytes(b"".join(((1 << len(t)) - 1).to_bytes(n, "little") for t, n in zip(texts, sizes, strict=True)), "little")
    v = full
    for c in text:
        u = v & joined[c]
        if u:
            v = ((v + u) | (v - u)) & full
    whole, at, out = v.to_bytes(sum(sizes), "little"), 0, []
    for t, n in zip(texts, sizes, strict=True):
        out.append(len(t) - int.from_bytes(whole[at : at + n], "little").bit_count())
        at += n
    return out


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """The longest common block: its place in a and b, the first in a, then in b, and its length."""
    i = best = n = 0
    while i + n < len(a):
        if a[i : i + n + 1] in b:
            best, n = i, n + 1
        else:
            i += 1
    return best, b.find(a[best : best + n]), n


def _alike_above(a: str, b: str, least: float, most: int, held: SequenceMatcher) -> float:
    """_alike of texts of which neither holds the other and that have at most so many characters in common, or 0 if it is not
    above least. held is the matcher of the pair before: what it knows of an equal b is used again."""
    long = len(b) >= JUNK_FROM
    if long:
        if b != held.b:
            held.set_seq2(b)
        held.set_seq1(a)
    whole, found, left = len(a) + len(b), 0, min(len(a), len(b))
    regions = [(0, len(a), 0, len(b))]
    if long and max(len(a), len(b)) >= COUNTED_FROM and held.quick_ratio() <= least:
        return 0.0
    while regions:
        if 2.0 * min(found + left, most) / whole <= least:
            return 0.0
        alo, ahi, blo, bhi = regions.pop()
        left -= min(ahi - alo, bhi - blo)
        if long:
            i, j, n = held.find_longest_match(alo, ahi, blo, bhi)
        else:
            i, j, n = _longest(a[alo:ahi], b[blo:bhi])
            i, j = alo + i, blo + j
        if n:
            found += n
            both = [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
            regions += sorted((r for r in both if r[0] < r[1] and r[2] < r[3]), key=lambda r: min(r[1] - r[0], r[3] - r[2]))
            left += sum(min(r[1] - r[0], r[3] - r[2]) for r in both)
    return 2.0 * found / whole


def text_score(a: Column, b: Column) -> Column:
    """1 if equal, .92 if one holds the other, else their similarity; 0 if one is empty."""
    empty = (F.length(a) == 0) | (F.length(b) == 0)
    return F.when(a == b, 1.0).when(empty, 0.0).when(F.contains(a, b) | F.contains(b, a), 0.92).otherwise(similarity(a, b))


def numeric_tokens(text: Column, least: int = 2) -> Column:
    """Runs of at least ``least`` digits."""
    return F.regexp_extract_all(text, F.lit(f"[0-9]{{{least},}}"), F.lit(0))


#: Kinds of anchors: what two renditions of a text must share. The first six are hard.
ANCHORS = (
    ("id_number", r"[1-9][0-9]{16}[0-9Xx]"), ("mobile", r"1[3-9][0-9]{9}"), ("date", r"[0-9]{4}[年/-][0-9]{1,2}[月/-][0-9]{1,2}"),
    ("case_no", r"[（(〔\[][0-9]{4}[）)〕\]][^0-9，,。]{1,12}[0-9]+号"), ("long_number", r"[0-9]{6,}"), ("contract_no", r"[A-Z]{2,}-?[0-9]{3,}"),
    ("amount", r"[0-9][0-9,]*(?:\.[0-9]+)?(?:万|亿)?元"), ("percent", r"[0-9]+(?:\.[0-9]+)?%"),
)
HARD_ANCHORS = 6


def anchors(text: Column, most: int = 40) -> Column:
    """array<string> of kind=value and of the first, middle and last phrase of 12 characters of a longer text."""
    of_kind = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.concat(F.lit(f"{kind}="), v))
    none = F.array().cast("array<string>")
    # every kind has a digit
    found = F.when(F.rlike(text, F.lit("[0-9]")), F.concat(*[of_kind(kind, pattern) for kind, pattern in ANCHORS])).when(text.isNotNull(), none)

    def of(plain: Column) -> Column:
        n = F.length(plain)
        middle = F.greatest(F.lit(1), F.floor(n / 2).cast("int") - 5)
        return F.when(n >= 12, F.array(*[F.concat(F.lit("phrase="), x) for x in (F.left(plain, F.lit(12)), F.substr(plain, middle, F.lit(12)), F.right(plain, F.lit(12)))]))

    phrases = bind(strip_marks(text), of)
    return F.slice(F.array_distinct(F.concat(found, F.coalesce(phrases, none))), 1, most)


def hard(values: Column) -> Column:
    """Of anchors the hard ones."""
    kinds = "|".join(k for k, _ in ANCHORS[:HARD_ANCHORS])
    return F.filter(values, lambda v: v.rlike(f"^(?:{kinds})="))


def page_compact(text: Column) -> Column:
    """Lower case, one zero, letters, digits and currency signs alone."""
    return F.regexp_replace(F.translate(F.lower(normalize(text)), "〇○", "00"), r"(?U)[^\w￥¥]+", "")


def page_tokens(text: Column, least: int = 3) -> Column:
    """Distinct tokens of a page: segments between marks (of 4 to 40 characters, longer ones in pieces of 18), runs of letters
    and digits, and overlapping pieces of 8, 6 and 4 ideographs."""
    none = F.array().cast("array<string>")
    pieces = lambda k, size, step: F.transform(F.sequence(F.lit(0), F.length(k) - 1, F.lit(step)), lambda s: F.substr(k, s + 1, F.lit(size)))
    long = lambda k: F.filter(pieces(k, 18, 18), lambda c: F.length(c) >= 6)
    segment = lambda k: F.when(F.length(k).between(4, 40), F.array(k)).when(F.length(k) > 40, long(k)).otherwise(none)
    # letters and digits of ASCII alone need no more than lower case; a segment that comes again gives what it gave
    compacted = lambda p: F.when(F.rlike(p, F.lit("^[A-Za-z0-9]*$")), F.lower(p)).otherwise(page_compact(p))
    segments = lambda t: F.transform(F.array_distinct(F.split(t, r"[\n\r\t ,，。；;：:、()（）]+", -1)), compacted)
    phrases = lambda t: F.flatten(F.transform(segments(t), segment))
    numbers = lambda whole: F.regexp_extract_all(whole, F.lit(r"[A-Za-z0-9]{3,}|[￥¥]?[0-9][0-9.,:：/-]{2,}"), F.lit(0))
    ideographs = lambda whole: F.regexp_replace(whole, "[^一-鿿]+", "")
    whole_ones = lambda k, n: F.when(F.length(k) >= n, F.filter(pieces(k, n, n // 2), lambda c: F.length(c) == n)).otherwise(none)
    grams = lambda whole: bind(ideographs(whole), lambda k: F.concat(*[whole_ones(k, n) for n in (8, 6, 4)]))
    of_whole = lambda t: bind(page_compact(t), lambda whole: F.concat(numbers(whole), grams(whole)))
    return F.array_distinct(F.filter(bind(text, lambda t: F.concat(phrases(t), of_whole(t))), lambda t: F.length(t) >= least))


# --- numbers ---


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digit_sum(value: Column, alphabet: str, weights: tuple[int, ...]) -> Column:
    places = F.transform(F.slice(F.split(value, ""), 1, len(weights)), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.aggregate(F.zip_with(places, F.array(*map(F.lit, weights)), lambda d, w: d * w), F.lit(0), lambda a, x: a + x)


def valid_id_number(value: Column) -> Column:
    """Shape and check digit (modulo 11) of an identity number."""
    check = F.substr(F.lit(ID_CHECKS), F.pmod(_digit_sum(value, "0123456789", ID_WEIGHTS), F.lit(11)) + 1, F.lit(1))
    return F.coalesce(F.when(value.rlike("^[1-9][0-9]{16}[0-9X]$"), check == F.right(value, F.lit(1))).otherwise(F.lit(False)), F.lit(False))


def valid_credit_code(value: Column) -> Column:
    """Shape and check character (base 31, weights are powers of 3 modulo 31) of a credit code."""
    weights = tuple(pow(3, i, 31) for i in range(17))
    place = F.pmod(31 - F.pmod(_digit_sum(value, CREDIT_ALPHABET, weights), F.lit(31)), F.lit(31)) + 1
    check = F.substr(F.lit(CREDIT_ALPHABET), place, F.lit(1))
    return F.coalesce(F.when(value.rlike(f"^[{CREDIT_ALPHABET}]{{18}}$"), check == F.right(value, F.lit(1))).otherwise(F.lit(False)), F.lit(False))


def validation(kind: Column, value: Column) -> Column:
    """struct<passed, failed, confidence> of a value of a typed format."""
    plain = F.upper(F.regexp_replace(value, r"(?U)[\s\-－—–]", ""))
    card = plain.rlike("^[0-9]{16,20}$") & ~plain.rlike(r"^(.)\1*$")
    mail = F.trim(value).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    named = lambda passed, failed, confidence: F.struct(
        F.array(*map(F.lit, passed)).cast("array<string>").alias("passed"), F.array(*map(F.lit, failed)).cast("array<string>").alias("failed"), F.lit(confidence).alias("confidence")
    )
    two = lambda test, name, good, bad: F.when(test, named([name], [], good)).otherwise(named([], [name], bad))
    return (
        F.when(kind == "CN_ID_CARD", two(valid_id_number(plain), "cn_id_checksum", 0.99, 0.2))
        .when(kind == "CN_CREDIT_CODE", two(valid_credit_code(plain), "credit_code_checksum", 0.98, 0.25))
        .when(kind == "CN_PHONE", two(plain.rlike("^1[3-9][0-9]{9}$"), "cn_mobile_shape", 0.96, 0.82))
        .when((kind == "CN_BANK_CARD") & card & luhn(plain), named(["bank_card_shape", "luhn"], [], 0.95))
        .when(kind == "CN_BANK_CARD", two(card, "bank_card_shape", 0.88, 0.35))
        .when(kind == "EMAIL_ADDRESS", two(mail, "email_shape", 0.96, 0.82))
        .when(kind == "CONTRACT_NO", two(F.length(plain).between(4, 80) & plain.rlike("[A-Za-z0-9]"), "contract_no_shape", 0.9, 0.82))
        .otherwise(named([], [], 0.82))
    )


def stable_seed(text: Column) -> Column:
    """The first eight hexadecimal digits of the MD5, as a number."""
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("long")


def alpha_index(index: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA: base 26 without a zero, as long as any bigint needs; negative ones give A."""
    whole = F.greatest(index.cast("long"), F.lit(0).cast("long"))
    # each step takes the last letter of what is left; 14 letters are more than any bigint has
    start = F.struct(whole.alias("left"), F.lit("").alias("out"))
    letter = lambda n: F.char(F.pmod(n, F.lit(26)) + 65)
    rest = lambda n: F.call_function("div", n, F.lit(26)) - 1
    step = lambda s, _: F.when(s["left"] < 0, s).otherwise(F.struct(rest(s["left"]).alias("left"), F.concat(letter(s["left"]), s["out"]).alias("out")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda s: s["out"])


def serial_index(index: Column) -> Column:
    """甲 to 癸, then 第11, 第12 ..."""
    return F.when(index < len(SERIALS), F.substr(F.lit(SERIALS), index.cast("int") + 1, F.lit(1))).otherwise(F.concat(F.lit("第"), (index + 1).cast("string")))


def greek_index(index: Column) -> Column:
    """Greek letters, then again with the number of the round from 2."""
    n = len(GREEK)
    letter = F.substr(F.lit(GREEK), F.pmod(index.cast("int"), F.lit(n)) + 1, F.lit(1))
    return F.concat(letter, F.when(index >= n, (F.floor(index / n) + 1).cast("string")).otherwise(""))


def amount(text: Column) -> Column:
    """The number of an amount in figures, with 万 and 亿 as factors; null if there is none."""
    figure = F.regexp_replace(F.regexp_extract(text, r"([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:亿|万)?元?", 1), ",", "").try_cast("double")
    factor = F.when(text.rlike(r"[0-9]\s*亿"), 1e8).when(text.rlike(r"[0-9]\s*万"), 1e4).otherwise(1.0)
    return figure * factor


# --- dates ---


def mask_date(text: Column) -> Column:
    """A date with its year alone: YYYY年**月**日, YYYY-**-** or with the separator it has; [日期] without a year."""
    year = F.regexp_extract(text, r"([0-9]{4})", 1)
    mark = F.when(F.contains(text, F.lit("/")), "/").otherwise("-")
    short = text.rlike(r"^\s*[0-9]{4}[/-][0-9]{1,2}\s*$")
    return (
        F.when(year == "", "[日期]")
        .when(F.contains(text, F.lit("年")), F.concat(year, F.lit("年**月**日")))
        .when(short, F.concat(year, mark, F.lit("**")))
        .otherwise(F.concat(year, mark, F.lit("**"), mark, F.lit("**")))
    )


def shift_date(day: Column, key: Column) -> Column:
    """A date moved by 7 to 126 days, the same for the same key."""
    return F.date_add(day, (F.pmod(stable_seed(key), F.lit(120)) + 7).cast("int"))


# --- offsets ---


def bind(value: Column, body: object) -> Column:
    """body of a value that is worked out once: what a lambda captures would be evaluated for each element."""
    return F.transform(F.array(value), body).getItem(0)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,text>> of a pattern's matches, half-open in code points. The pattern must not match the empty text.

    Matches are marked where they stand, so that one pass gives them and what stands between; one fold gives all offsets. A
    text that has the marks itself is matched and split apart.
    """
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def placed(x: Column) -> Column:
        found, gaps = x["found"], x["gaps"]
        pair = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        ends = F.aggregate(pair, F.array(F.lit(0)), lambda at, p: F.concat(at, F.array(F.element_at(at, -1) + F.length(p["g"]) + F.length(p["m"]))))
        return F.zip_with(found, F.slice(ends, F.lit(2), F.size(found)), lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))

    parts = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    marked = bind(parts, lambda p: F.struct(F.filter(p, lambda _, i: i % 2 == 1).alias("found"), F.filter(p, lambda _, i: i % 2 == 0).alias("gaps")))
    apart = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    found = F.when(F.contains(text, F.lit(MARK)), apart).otherwise(marked)
    return bind(found, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))
