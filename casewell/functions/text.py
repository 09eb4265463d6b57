"""Text functions. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell import rules as R
from casewell.rules import Rule


def strip(col: Column) -> Column:
    """Remove whitespace of any script from both ends."""
    return F.btrim(col, F.lit(R.WHITESPACE))


def clean_text(col: Column) -> Column:
    """Whitespace runs to one space, ends trimmed, empty to NULL."""
    return F.nullif(F.trim(F.regexp_replace(col, R.SPACE_RUN, " ")), F.lit(""))


def is_noise_row(cells: Column, header: str, title: str) -> Column:
    """A repeated header row, or a title row whose other cells are all blank."""
    first = F.lower(strip(F.coalesce(F.try_element_at(cells, F.lit(1)), F.lit(""))))
    rest = F.slice(cells, F.lit(2), F.greatest(F.size(cells), F.lit(1)))
    others = F.exists(rest, lambda c: F.coalesce(c.rlike(R.NON_SPACE), F.lit(False)))
    return first.startswith(header) | (F.contains(first, F.lit(title)) & ~others)


def parse_yes_no(col: Column, yes: str = "s", no: str = "n") -> Column:
    """True or false by the first letters, NULL for anything else."""
    text = F.lower(strip(col))
    return F.when(text.startswith(yes), True).when(text.startswith(no), False)


def long_number_pattern(min_digits: int = R.MIN_DIGITS) -> str:
    """Digit run with inner dots, hyphens or spaces holding at least `min_digits`.

    The possessive quantifiers keep the matcher iterative on very long runs.
    """
    return rf"(?U)\d(?:[.\- ]*+\d){{{min_digits - 1},}}+"


def deidentify_rules(min_digits: int = R.MIN_DIGITS) -> list[Rule]:
    return [
        Rule("reference_id", R.REFERENCE_ID, "", "remoto"),
        Rule("badge", R.BADGE_NUMBER, R.BADGE_MARK),
        Rule("long_number", long_number_pattern(min_digits), R.NUMBER_MARK),
        Rule("blank_run", R.BLANK_RUN, " "),
    ]


def _possible(col: Column, rule: Rule) -> Column | None:
    return F.contains(F.lower(col), F.lit(rule.needs)) if rule.needs else None


def replace_rule(col: Column, rule: Rule) -> Column:
    replaced = F.regexp_replace(col, rule.pattern, rule.replacement)
    possible = _possible(col, rule)
    return replaced if possible is None else F.when(possible, replaced).otherwise(col)


def drop_reference_ids(col: Column) -> Column:
    return replace_rule(col, deidentify_rules()[0])


def mask_badges(col: Column) -> Column:
    return replace_rule(col, deidentify_rules()[1])


def mask_long_numbers(col: Column, min_digits: int = R.MIN_DIGITS) -> Column:
    return replace_rule(col, deidentify_rules(min_digits)[2])


def squeeze(col: Column) -> Column:
    return strip(replace_rule(col, deidentify_rules()[3]))


def deidentify(col: Column, min_digits: int = R.MIN_DIGITS) -> Column:
    """All de-identification rules in their fixed order; NULL and '' pass through."""
    for rule in deidentify_rules(min_digits):
        col = replace_rule(col, rule)
    return strip(col)


def apply_rules(df: DataFrame, col: str, rules: Sequence[Rule], prefix: str = "hits_") -> DataFrame:
    """Apply an ordered rule table to `col` and count the hits of each rule.

    Each rule sees the text left by the rules before it; every step is its own
    projection, so nothing is evaluated twice, and only texts with a hit are rewritten.
    """
    for rule in rules:
        text, hits = F.col(col), f"{prefix}{rule.name}"
        found = F.regexp_count(text, F.lit(rule.pattern))
        possible = _possible(text, rule)
        if possible is not None:
            found = F.when(possible, found).when(text.isNotNull(), 0)
        df = df.withColumn(hits, found)
        replaced = F.regexp_replace(text, rule.pattern, rule.replacement)
        df = df.withColumn(col, F.when(F.col(hits) > 0, replaced).otherwise(text))
    return df.withColumn(col, strip(F.col(col)))


def label_code(col: Column, sep: str = R.LABEL_SEPARATOR) -> Column:
    """Text before the first separator, or the whole text without one."""
    return F.split_part(col, F.lit(sep), F.lit(1))


def label_name(col: Column, prefix: str = R.LABEL_PREFIX) -> Column:
    """Text after the leading numeric code, which is removed once."""
    return F.regexp_replace(col, prefix, "")


def first_group(col: Column, pattern: str) -> Column:
    """First group of the leftmost match, NULL when nothing matches."""
    return F.nullif(F.regexp_extract(col, pattern, 1), F.lit(""))


def first_int(col: Column, pattern: str) -> Column:
    return first_group(col, pattern).cast("int")


def matches_any_case(col: Column, pattern: str) -> Column:
    return col.rlike(f"(?iU){pattern}")


def prefix_or_phrase(code: Column, text: Column, prefix: str, phrase: str) -> Column:
    """Code prefix OR phrase in the text, with SQL three-valued logic."""
    return code.startswith(prefix) | matches_any_case(text, phrase)


def marker_class(
    text: Column,
    override: Column,
    markers: Mapping[str, str],
    default: str,
) -> Column:
    """Class of an exclusive marker pair, unless `override` already names a class.

    `markers` maps each of two classes to its pattern. Both or none found, or a NULL
    text, gives `default`.
    """
    (a, a_pattern), (b, b_pattern) = markers.items()
    has_a, has_b = matches_any_case(text, a_pattern), matches_any_case(text, b_pattern)
    # Nested, so that each pattern is searched once.
    marked = F.when(has_a, F.when(has_b, default).otherwise(a)).when(has_b, b)
    return F.when(override.isin(a, b), override).otherwise(F.coalesce(marked, F.lit(default)))


def has_prefix(col: Column, codes: str, after: str = " ") -> Column:
    """The text starts with one of the one-letter codes; NULL counts as empty."""
    return F.coalesce(col, F.lit("")).rlike(f"^[{codes}]{after}")


def code_group(
    col: Column,
    groups: Mapping[str, str],
    default: str,
    missing: str = R.DIAGNOSIS_MISSING,
    width: int = 2,
) -> Column:
    """Group of the first `width` letters of a code, `default` when not listed."""
    pairs = [F.lit(x) for pair in groups.items() for x in pair]
    code = F.substring(F.coalesce(col, F.lit(missing)), 1, width)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def content_key(col: Column, version: str | None = None) -> Column:
    """sha256 hex of the text, or of `version|text`. NULL stays NULL."""
    if version is not None:
        col = F.concat(F.lit(f"{version}|"), col)
    return F.sha2(col, 256)


def unwrap_quotes(col: Column) -> Column:
    """Strip, then remove one layer of equal quotes around the text and strip again."""
    text = strip(col)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    quoted = (F.length(text) >= 2) & (first == last) & first.isin('"', "'")
    inner = strip(F.substring(text, F.lit(2), F.length(text) - 2))
    return F.when(quoted, inner).otherwise(text)


def already_marked(col: Column, mark: str = R.NAME_MARK) -> Column:
    return F.contains(col, F.lit(mark))


def candidates(df: DataFrame, col: str, pattern: str, n: int) -> DataFrame:
    """The first `n` distinct texts that match, in text order."""
    return (
        df.select(col)
        .filter(matches_any_case(F.col(col), pattern))
        .distinct()
        .orderBy(col)
        .limit(n)
    )


def pair_key(a: Column, b: Column, sep: str = "|") -> Column:
    return F.concat(a.cast("string"), F.lit(sep), b.cast("string"))
