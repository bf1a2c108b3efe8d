"""Detection rules as boolean Columns.

A rule becomes one Column over the event row, so matching is a projection: no join, no UDF. With
``column_fields`` the tests read real columns and simple rules are pushed down to the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact_names
from ..sources.rule_pack import Matcher, Rule, RuleError, RulePack, field_key

FieldLookup = Callable[[str], Column]
RULES_PER_ARRAY = 100


def map_fields(column: str = "fields") -> FieldLookup:
    """Field lookup in a map column."""
    return lambda key: F.try_element_at(F.col(column), F.lit(key))


def column_fields(df: DataFrame, extra: dict[str, Column] | None = None) -> FieldLookup:
    """Field lookup by column name; unknown fields are absent."""
    known: dict[str, Column] = {field_key(c): F.col(c) for c in df.columns}
    known.update(extra or {})
    return lambda key: known.get(key, F.lit(None).cast("string"))


def slug_column(title: Column) -> Column:
    """The slug of a rule title as a Column, for tables of rules."""
    folded = F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]+", "_")
    return F.trim(folded, F.lit("_"))


def glob_regex(pattern: str) -> str:
    """Whole-value pattern of a glob with ``*`` and ``?``.

    A literal ``*`` in the data is an ordinary character here.
    """
    parts = [{"*": ".*", "?": "."}.get(p, re.escape(p)) for p in re.split(r"([*?])", pattern) if p]
    return r"(?s)\A" + "".join(parts) + r"\z"


def value_matches(actual: Column, modifier: str, values: Iterable[str]) -> Column:
    """Any of the values matches, ignoring case. Wildcards override the modifier."""
    folded = F.lower(actual)
    plain = [v.lower() for v in values if not re.search(r"[*?]", v)]
    globs = [v.lower() for v in values if re.search(r"[*?]", v)]
    tests = []
    if plain and modifier == "":
        tests.append(folded.isin(*plain))
    elif plain:
        compare = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[modifier]
        tests += [compare(folded, F.lit(v)) for v in plain]
    # "*" alone means any value; the absent and the empty value are excluded by the caller.
    tests += [F.lit(True) if set(g) == {"*"} else F.rlike(folded, F.lit(glob_regex(g))) for g in globs]
    return reduce(or_, tests) if tests else F.lit(False)


def matcher_column(matcher: Matcher, fields: FieldLookup) -> Column:
    """Never null: an absent or empty field does not match, so that NOT stays two-valued."""
    actual = fields(matcher.key)
    test = (actual != "") & value_matches(actual, matcher.modifier, matcher.values)
    return F.coalesce(test, F.lit(False))


def condition_tree(rule: Rule) -> tuple:
    """Nested ("and"|"or"|"not"|"sel"|"false", ...) of a rule condition, with quantifiers expanded."""
    tokens = re.findall(r"[()]|[^\s()]+", rule.condition)
    names = list(rule.selections)
    pos = 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise RuleError(f"condition of '{rule.title}' ends too early")
        pos += 1
        return tokens[pos - 1]

    def chain(word: str, operand: Callable[[], tuple]) -> tuple:
        terms = [operand()]
        while peek() == word:
            take()
            terms.append(operand())
        return terms[0] if len(terms) == 1 else (word, *terms)

    def any_of() -> tuple:
        return chain("or", lambda: chain("and", term))

    def term() -> tuple:
        word = take()
        if word == "not":
            return ("not", term())
        if word == "(":
            inner = any_of()
            if peek() != ")":
                raise RuleError(f"missing ')' in condition of '{rule.title}'")
            take()
            return inner
        if word in ("1", "all") and peek() == "of":
            take()
            wanted = take()
            stem = wanted.rstrip("*")
            hits = [n for n in names if wanted == "them" or n == wanted
                    or (wanted.endswith("*") and n.startswith(stem))]
            if not hits:
                return ("false",)
            return ("and" if word == "all" else "or", *[("sel", h) for h in hits])
        if word in ("and", "or", "of", "them", ")"):
            raise RuleError(f"unexpected '{word}' in condition of '{rule.title}'")
        if word not in rule.selections:
            raise RuleError(f"condition of '{rule.title}' names unknown selection '{word}'")
        return ("sel", word)

    tree = any_of()
    if pos != len(tokens):
        raise RuleError(f"unexpected '{tokens[pos]}' in condition of '{rule.title}'")
    return tree


def rule_column(rule: Rule, fields: FieldLookup | None = None) -> Column:
    """The rule as a never-null boolean Column."""
    fields = fields or map_fields()

    def build(node: tuple) -> Column:
        kind, *rest = node
        if kind == "sel":
            tests = [matcher_column(m, fields) for m in rule.selections[rest[0]]]
            return reduce(and_, tests) if tests else F.lit(True)
        if kind == "false":
            return F.lit(False)
        if kind == "not":
            return ~build(rest[0])
        return reduce(and_ if kind == "and" else or_, [build(r) for r in rest])

    return build(condition_tree(rule))


def matched_rules(pack: RulePack, fields: FieldLookup | None = None) -> Column:
    """Array of the slugs that match one event. Large packs are built from several arrays, which
    keeps the generated code of each below the limits."""
    flags = [F.when(rule_column(r, fields), F.lit(r.slug)) for r in pack.rules]
    chunks = [flags[i:i + RULES_PER_ARRAY] for i in range(0, len(flags), RULES_PER_ARRAY)]
    if not chunks:
        return F.array().cast("array<string>")
    arrays = [compact_names(*chunk) for chunk in chunks]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def load_errors(spark, pack: RulePack) -> DataFrame:
    return spark.createDataFrame(list(pack.load_errors), "file string, error string")


def rule_hits(events: DataFrame, pack: RulePack, keys: list[str] | None = None,
              fields: FieldLookup | None = None) -> DataFrame:
    """Hits per key and rule: (keys, slug, title, level, hits).

    Only matching events are exploded, and counting combines before the shuffle.
    """
    keys = keys if keys is not None else ["artifact_id"]
    slugs = matched_rules(pack, fields)
    counted = (
        events.select(*keys, F.explode(slugs).alias("slug")).groupBy(*keys, "slug").agg(F.count("*").alias("hits"))
    )
    # One map lookup instead of a join: the pack is a driver-side constant.
    info = {r.slug: r for r in pack.rules}

    def pick(attr: str) -> Column:
        pairs = [x for slug, r in info.items() for x in (F.lit(slug), F.lit(getattr(r, attr)))]
        return F.try_element_at(F.create_map(*pairs), F.col("slug")) if pairs else F.lit(None).cast("string")

    return counted.select(*keys, "slug", pick("title").alias("title"), pick("level").alias("level"), "hits")


def order_hits(hits: DataFrame) -> DataFrame:
    """Most hits first, then by title."""
    return hits.orderBy(F.col("hits").desc(), F.col("title"))
