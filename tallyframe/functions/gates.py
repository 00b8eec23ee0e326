"""Row predicates: which rows take part, which clauses go together, which text counts as what."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions import clauses
from tallyframe.functions.channels import _CLAUSE, _SPREAD, clause_token, parameter_key
from tallyframe.functions.text import compact, is_actual_result, nfkc

# fixed values: notes and names of sample rows that need no photo
NOT_USED = ("本次检测未使用", "本次检验未使用")
NOT_PHYSICAL = ("软件", "模块", "升级包", "证书", "功能")
# fixed values: headings of tables that list equipment, not samples
AUXILIARY_HEADINGS = ("配合检测", "配合使用", "辅助设备", "陪测设备", "检测用设备", "测试用设备")
# fixed values: model cells that name every model; clauses whose children are printed without a point
ALL_MODELS = ("全部型号", "所有型号", "全部", "通用")
UNDOTTED_PARENTS = ("12", "14")


def _any_of(c: Column, parts: Iterable[str]) -> Column:
    return c.rlike("|".join(parts))


def sequence_selected(number: Column, wanted: int | range | tuple[int, int] | Iterable[int] | None) -> Column:
    """All (None), one number, a range (end excluded), a pair (both ends, either order) or a set of numbers."""
    if wanted is None:
        return F.lit(True)
    if isinstance(wanted, int):
        return number == wanted
    if isinstance(wanted, range):
        steps = F.pmod(number - wanted.start, F.lit(abs(wanted.step))) == 0
        return number.between(min(wanted), max(wanted)) & steps if len(wanted) else F.lit(False)
    if isinstance(wanted, tuple) and len(wanted) == 2:
        return number.between(min(wanted), max(wanted))
    return number.isin([int(x) for x in wanted])


def photo_scope(name: Column, notes: Column) -> Column:
    """struct(applies, reason): rows marked as not used, or that name no physical object, need no photo."""
    reason = F.when(_any_of(compact(notes), NOT_USED), "sample_marked_not_used").when(_any_of(compact(name), NOT_PHYSICAL), "non_physical_sample_entry")
    return F.struct(reason.isNull().alias("applies"), reason.alias("reason"))


def is_auxiliary_table(text_above: Column) -> Column:
    """The text printed above a table says that it lists equipment."""
    return _any_of(compact(text_above), AUXILIARY_HEADINGS)


def _ends(expression: Column) -> tuple[Column, Column]:
    pattern = rf"^({_CLAUSE}){_SPREAD}({_CLAUSE})$"
    return tuple(F.nullif(F.regexp_extract(clause_token(expression), pattern, i), F.lit("")) for i in (1, 2))


def _between(clause: Column, expression: Column) -> Column:
    """A sibling of both ends of a range, between them in either order."""
    plain = clause_token(clause).rlike(f"^{_CLAUSE}$")
    first, last = _ends(expression)
    same_depth = F.size(clauses.path(clause_token(clause))) == F.size(clauses.path(first))
    inside = clauses.in_range(clause_token(clause), first, last) | clauses.in_range(clause_token(clause), last, first)
    return F.coalesce(plain & same_depth & inside, F.lit(False))


def clause_compatible(source: Column, target: Column) -> Column:
    """The source clause is the target, lies below it, or in its range; some parents have undotted children."""
    s, t = clause_token(source), clause_token(target)
    below = s.startswith(F.concat(t, F.lit("."))) | (t.isin(*UNDOTTED_PARENTS) & s.startswith(t))
    return _between(source, target) | ((s != "") & (t != "") & ((s == t) | below))


def expression_contains(expression: Column, clause: Column) -> Column:
    """A clause expression is the clause, lies below it, or is a range that holds it."""
    s, t = clause_token(expression), clause_token(clause)
    return (s != "") & (t != "") & ((s == t) | s.startswith(F.concat(t, F.lit("."))) | _between(clause, expression))


def refers_elsewhere(requirement: Column, own: Column, sections: Column) -> Column:
    """The text names another clause that has rows of its own (``sections``: all clauses with rows)."""
    named = F.regexp_extract_all(F.coalesce(requirement, F.lit("")), F.lit(r"(?<![0-9.])([0-9]+(?:\.[0-9]+)+)(?![0-9.])"), F.lit(1))
    others = F.array_remove(F.array_remove(F.transform(sections, clause_token), clause_token(own)), "")
    return F.arrays_overlap(named, others)


def model_applies(cell: Column, models: Column) -> Column:
    """The cell names all models, or one of ``models`` as a whole word ('DR-T' isn't in 'SR-T')."""
    spaced = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    folded = spaced(nfkc(F.coalesce(cell, F.lit(""))))
    edge = r"[\p{L}\p{N}-]"
    names = F.array_join(F.transform(F.filter(models, lambda m: spaced(m) != ""), lambda m: F.concat(F.lit(r"\Q"), spaced(m), F.lit(r"\E"))), "|")
    alone = (names != "") & F.regexp_like(folded, F.concat(F.lit(f"(?<!{edge})(?:"), names, F.lit(f")(?!{edge})")))
    return parameter_key(cell).isin(*ALL_MODELS) | alone


def is_clause_body(c: Column) -> Column:
    """A heading may begin so: not blank, and with neither a number nor a mathematical sign first."""
    return F.coalesce(F.trim(c), F.lit("")).rlike(r"^[^0-9±+\-≤≥=<>~～/\\]")


def has_exclusions(scope: Column) -> Column:
    """A scope that leaves something out, or is limited to something."""
    return compact(scope).rlike("[（(]除|仅检")


def is_recognised(methods: Column) -> Column:
    """Some evidence of a node came from a text recogniser."""
    return F.exists(F.coalesce(methods, F.array().cast("array<string>")), lambda m: F.coalesce(m.startswith("ocr:"), F.lit(False)))


def texts_correspond(a: Column, b: Column, least: int = 12) -> Column:
    """Locator texts that are equal, or of which one holds the other; short ones must be equal."""
    long_enough = F.least(F.length(a), F.length(b)) >= least
    return (a != "") & (b != "") & ((a == b) | (long_enough & (F.contains(a, b) | F.contains(b, a))))


def result_of_split_rows(results: Column) -> Column:
    """struct(result, reason) of a requirement that is printed on several rows: array of their results."""
    seen = F.transform(results, compact)
    one = F.size(F.array_distinct(seen)) == 1
    done = F.exists(seen, lambda r: (r == "符合要求") | is_actual_result(r))
    result = F.when(F.array_contains(seen, "不符合要求"), "不符合要求").when(F.array_contains(seen, ""), None).when(done, "符合要求").when(one, F.try_element_at(results, F.lit(1)))
    return F.struct(result.alias("result"), F.when(result.isNull(), "split_report_rows_unresolved").otherwise("split_report_rows_aggregated").alias("reason"))


def facts_equal(a: Column, b: Column) -> Column:
    """Equal lists of facts; a list repeated as a whole counts once."""
    n, m = F.size(a), F.size(b)
    times = lambda long, short: F.flatten(F.array_repeat(short, F.when(F.size(short) > 0, (F.size(long) / F.size(short)).cast("int")).otherwise(0)))
    return F.when(n >= m, a == F.when(m == n, b).otherwise(times(a, b))).otherwise(b == times(b, a))


def one_value(readings: Column) -> Column:
    """What a channel says: its only distinct reading, or null if it abstains."""
    distinct = F.array_distinct(readings)
    return F.when(F.size(distinct) == 1, F.try_element_at(distinct, F.lit(1)))


def agreed_by_two(channels: Column) -> Column:
    """struct(value, reason) over an array of channels' readings: the one value that two channels or more agree on."""
    single = F.filter(F.transform(channels, one_value), lambda v: v.isNotNull())
    backed = F.filter(F.array_distinct(single), lambda v: F.size(F.filter(single, lambda x: x == v)) >= 2)
    value = F.when(F.size(backed) == 1, F.try_element_at(backed, F.lit(1)))
    split = (F.size(F.array_distinct(single)) > 1) & (F.size(backed) == 0)
    return F.struct(value.alias("value"), F.when(value.isNotNull(), "two_channel_agreement").when(split, "channels_disagree").otherwise("not_read_by_two_channels").alias("reason"))


def read_alike(channels: Column) -> Column:
    """The value that all channels with a reading read alike, at least two of them; else null."""
    read = F.filter(channels, lambda c: F.size(c) > 0)
    every = F.array_distinct(F.flatten(read))
    return F.when((F.size(read) >= 2) & (F.size(every) == 1), F.try_element_at(every, F.lit(1)))


def without_lower_bounds(values: Column) -> Column:
    """Measured values of structs (comparator, value): '<a' cells that can't change the maximum are left out.

    All stay if nothing was measured exactly, a bound lies above the maximum, or a comparator is another.
    """
    exact = F.filter(values, lambda v: v["comparator"].isNull())
    most = F.array_max(F.transform(exact, lambda v: F.abs(v["value"])))
    settled = F.forall(values, lambda v: v["comparator"].isNull() | (v["comparator"].isin("<", "<=") & (v["value"] <= most)))
    return F.when((F.size(exact) > 0) & settled, exact).otherwise(values)
