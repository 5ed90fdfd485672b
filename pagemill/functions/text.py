"""Text functions from Column to Column.

Patterns run with FLAGS so that Java classes, case folding and line ends mean
what they mean for Unicode text; ``strip`` removes Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?imuUd)"
CJK = r"一-鿿"
SPACE = r"[\s\x1c-\x1f]"
WORD = r"\w\p{No}"

# Misread words and what they stand for, in the order they are applied.
TYPOS = {
    "invioce": "invoice",
    "invoce": "invoice",
    "recipt": "receipt",
    "reciept": "receipt",
    "amout": "amount",
    "amounr": "amount",
    "totla": "total",
    "totol": "total",
    "adddress": "address",
    "comapny": "company",
    "compnay": "company",
    "numebr": "number",
    "nubmer": "number",
    "datc": "date",
    "dete": "date",
}


def _halfwidth() -> tuple[str, str]:
    """Full-width digits and letters, and their half-width forms."""
    plain = [chr(c) for a, b in (("0", "9"), ("A", "Z"), ("a", "z")) for c in range(ord(a), ord(b) + 1)]
    return "".join(chr(ord(c) + 0xFEE0) for c in plain), "".join(plain)


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_text(c), rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column | str) -> Column:
    return ~F.rlike(_text(c), F.lit(rf"(?U)[^{SPACE[1:-1]}]"))


def fullwidth_to_halfwidth(c: Column | str) -> Column:
    wide, plain = _halfwidth()
    return F.translate(_text(c), wide, plain)


def correct_words(c: Column | str) -> Column:
    """Without CJK: lower case, misreadings replaced anywhere.  With CJK: only whole runs between CJK."""
    text = _text(c)
    plain, mixed = F.lower(text), text
    for wrong, right in TYPOS.items():
        plain = F.replace(plain, F.lit(wrong), F.lit(right))
        mixed = F.regexp_replace(mixed, rf"(?iu)(?<![^{CJK}]){wrong}(?![^{CJK}])", right)
    return F.when(text.rlike(rf"[{CJK}]"), mixed).otherwise(plain)


def remove_noise(c: Column | str) -> Column:
    """Drop short lines without a letter or digit; trim symbols from the others."""
    keep = F.filter(F.split(_text(c), "\n"), lambda s: s.rlike(r"(?U)[\p{L}\p{N}]") | (F.char_length(s) >= 3))
    return F.array_join(F.transform(keep, lambda s: F.regexp_replace(s, rf"(?U)\A[^{WORD}]+|[^{WORD}]+\z", "")), "\n")


def normalize_whitespace(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_text(c), " {2,}", " "), "\n{3,}", "\n\n")


def process_text(c: Column | str, chars: bool = True, typos: bool = True, noise: bool = True) -> Column:
    """All cleaning steps; null and empty texts give an empty text."""
    text = F.coalesce(_text(c), F.lit(""))
    for on, step in ((chars, fullwidth_to_halfwidth), (typos, correct_words), (noise, remove_noise)):
        text = step(text) if on else text
    return strip(normalize_whitespace(text))


def process_lines(lines: Column | str) -> Column:
    """Clean the text of each line struct and keep the rest; empty lines stay."""
    return F.transform(_text(lines), lambda x: x.withField("text", process_text(x["text"])))


def clean_ocr_text(c: Column | str) -> Column:
    text = F.regexp_replace(F.coalesce(_text(c), F.lit("")), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def normalize_amount(c: Column | str) -> Column:
    """The first number after currency marks are removed, or null."""
    plain = strip(F.regexp_replace(_text(c), "(?iu)[¥￥$€＄]|元|圆|CNY|RMB", ""))
    found = F.regexp_substr(plain, F.lit(r"(?U)[\d,]+\.?\d*"))
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def normalize_date(c: Column | str) -> Column:
    """yyyy-mm-dd by the first form found anywhere; the calendar is not checked."""
    text = _text(c)

    def form(pattern: str) -> Column:
        part = lambda i: F.regexp_extract(text, pattern, i)
        iso = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
        return F.when(text.rlike(pattern), iso)

    return F.coalesce(
        form(r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"),
        form(r"(?U)(\d{4})[/-](\d{1,2})[/-](\d{1,2})"),
        form(r"(?U)(\d{4})(\d{2})(\d{2})"),
    )


def normalize_phone(c: Column | str) -> Column:
    digits = F.regexp_replace(_text(c), r"(?U)\D", "")
    return F.when(F.char_length(digits).between(10, 13), digits)


# Endings of company names, local first.
COMPANY_ENDINGS = ["公司", "有限公司", "股份公司", "集团", "企业", "工厂", "商店", "事务所", "银行"]
LATIN_ENDINGS = [r"Co\.", r"Ltd\.", "LLC", r"Inc\.", r"Corp\."]


def company_name(c: Column | str) -> Column:
    text = _text(c)
    found = [F.when(text.rlike(p), F.regexp_extract(text, p, 1)) for p in (rf"([一-龥]+(?:{'|'.join(e)}))" for e in (COMPANY_ENDINGS, LATIN_ENDINGS))]
    return strip(F.coalesce(*found))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Shared characters in percent, cut to a whole number; 0 if either is empty."""
    chars = lambda c: F.array_distinct(F.filter(F.split(F.lower(_text(c)), ""), lambda x: x != ""))
    share = F.size(F.array_intersect(chars(a), chars(b))) / F.size(F.array_union(chars(a), chars(b))) * 100
    empty = (F.coalesce(F.char_length(_text(a)), F.lit(0)) == 0) | (F.coalesce(F.char_length(_text(b)), F.lit(0)) == 0)
    return F.when(empty, F.lit(0)).otherwise(F.floor(share).cast("int"))


def text_lines(c: Column | str) -> Column:
    """Lines that hold more than white space, stripped."""
    return F.filter(F.transform(F.split(_text(c), "\n"), strip), lambda s: s != "")
