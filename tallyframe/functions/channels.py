"""Forms of a text for one purpose each: numeric reading, quotes, identities, table cells; and clause tokens at its head."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.text import comparison_text, compact, display_text, nfkc

# fixed values: two wordings of one project
PROJECT_ALIASES = {"电压、电流或能量的限制": "电压、电流和能量的限制"}
# fixed values: marks of footnotes in a table's first column
FOOTNOTE_MARK = r"[①-⑳]|\*[0-9]*"
_HAN = r"[\x{3400}-\x{9fff}]"
_CLAUSE = r"[0-9]+(?:\.[0-9]+)*"
_SPREAD = r"[~～〜∼至–—-]"


def layout_text(c: Column) -> Column:
    """Without layout white space; technical punctuation stays; null becomes ''."""
    return compact(c)


def _micro(c: Column) -> Column:
    """A u between a number and a base unit is micro."""
    return F.regexp_replace(c, r"(?i)(?<=[0-9])\s*u\s*(?=[glmnsvapΩ])", "μ")


def numeric_text(c: Column) -> Column:
    """Folded for reading numbers: one space stays between lines, so that no unit joins the next number."""
    folded = F.translate(nfkc(F.coalesce(c, F.lit(""))), "—–－−～，；：（）【】µΩ×", "----~,;:()[]μΩx")
    named = F.regexp_replace(F.regexp_replace(_micro(folded), "(?i)usec", "μs"), "(?i)msec", "ms")
    return display_text(F.regexp_replace(named, rf"(?<={_HAN}):\s*(?={_HAN})", ""))


def recognised_text(c: Column) -> Column:
    """Output of a text recogniser: NFKC, without trademark signs and white space."""
    return compact(F.regexp_replace(nfkc(c), "[™®©]", ""))


def quote_text(c: Column) -> Column:
    """For finding a quotation in its source: only layout and widths are folded."""
    return compact(_micro(F.translate(nfkc(F.coalesce(c, F.lit(""))), "—–－～，；：（）µΩ", "---~,;:()μΩ")))


def identity_text(c: Column) -> Column:
    """Letters, digits and Han of a report number or name, in upper case."""
    return F.regexp_replace(F.translate(F.upper(display_text(c)), "ＯＱ－", "OQ-"), r"[^0-9A-Z\x{3400}-\x{9fff}]+", "")


def math_text(c: Column) -> Column:
    """One sign for each comparison, range and minus."""
    return F.translate(compact(c), "＜＞≦≧~−", "<>≤≥～-")


def without_watermark(c: Column, owner: str, revision: str = "技术要求修订版") -> Column:
    """Without the repeated notes of confidentiality of ``owner`` (a pattern) and of the document's revision."""
    t = F.regexp_replace(c, rf"(?i){owner}专有机密文件.*?产品", "")
    return F.regexp_replace(t, rf"(?i){revision}[:：]?[A-Z](?={_HAN}|[A-Z0-9]|$)", "")


def clause_token(c: Column) -> Column:
    """A clause id as one token: no white space, no mark of continuation, no final points."""
    return F.regexp_replace(F.regexp_replace(compact(c), "^续", ""), "[.。]+$", "")


def plausible_clause(c: Column) -> Column:
    """The token if the cell is a clause id or a range of them (at most 32 characters), else ''."""
    token = clause_token(display_text(c))
    return F.when((F.length(display_text(c)) <= 32) & token.rlike(rf"^{_CLAUSE}(?:-{_CLAUSE})?$"), token).otherwise("")


def leading_clause(c: Column) -> Column:
    """The clause, or 'first-last', that a text begins with; else ''."""
    loose = _CLAUSE.replace(r"\.", r"\s*\.\s*")
    t = display_text(c)
    pattern = rf"^({loose})(?:\s*{_SPREAD}\s*({loose}))?(?=\s|[^0-9.]|$)"
    first, last = (clause_token(F.regexp_extract(t, pattern, i)) for i in (1, 2))
    return F.concat(first, F.when(last != "", F.concat(F.lit("-"), last)).otherwise(""))


def leading_subclause(c: Column) -> Column:
    """A clause of at least two numbers at the head of a text; else ''."""
    return F.regexp_extract(display_text(c), rf"^({_CLAUSE.replace('*', '+')})(?=\s|[^0-9.]|$)", 1)


def leading_marker(c: Column) -> Column:
    """The list marker 'a)' or the subclause at the head of a text; else ''."""
    t = display_text(c)
    letter = F.regexp_extract(t, r"^([A-Za-z])\s*[)）]", 1)
    return F.when(letter != "", F.concat(F.lower(letter), F.lit(")"))).otherwise(F.regexp_extract(t, rf"^({_CLAUSE.replace('*', '+')})", 1))


def project_name(c: Column, aliases: Mapping[str, str] = PROJECT_ALIASES) -> Column:
    """The name without white space, under its agreed wording."""
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(names, compact(c)), compact(c))


def parameter_key(c: Column) -> Column:
    """Name of a table's row: no footnote marks, brackets (nested ones too), white space or colons."""
    t = nfkc(F.regexp_replace(F.coalesce(c, F.lit("")), FOOTNOTE_MARK, ""))
    depth = F.regexp_count(t, F.lit("[(（]"))
    bare = F.aggregate(F.sequence(F.lit(0), depth), t, lambda s, _: F.regexp_replace(s, "[(（][^()（）]*[)）]", ""))
    return F.regexp_replace(bare, r"(?U)[\s:：]+", "")


def table_value(c: Column) -> Column:
    """Value of a cell for comparison; '+20/-25%' is '+20%/-25%'."""
    t = comparison_text(F.translate(nfkc(F.coalesce(c, F.lit(""))), "−–", "--"))
    t = F.regexp_replace(t, r"([+\-±]?[0-9]+(?:\.[0-9]+)?)/(-[0-9]+(?:\.[0-9]+)?)%", "$1%/$2%")
    return F.regexp_replace(t, "[。；;，,、]+$", "")


def same_number_written_differently(a: Column, b: Column) -> Column:
    """'0.70 mm' and '0.7 mm': equal but for the way in which equal numbers are written."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    values = lambda c: F.transform(F.regexp_extract_all(c, F.lit(number), F.lit(0)), lambda x: x.try_cast("decimal(38,18)"))
    return (F.regexp_replace(a, number, "#") == F.regexp_replace(b, number, "#")) & F.coalesce(values(a) == values(b), F.lit(False))
