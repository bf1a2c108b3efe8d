"""Detection rules from YAML files. Loading is configuration work on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

PACK_DIR = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rule_pack")
MODIFIERS = {"", "contains", "startswith", "endswith"}
NOT_SELECTIONS = {"condition", "timeframe"}


class RuleError(ValueError):
    """A rule file that cannot be used."""


@dataclass(frozen=True)
class Matcher:
    """One field test: any of the values, compared as the modifier says."""

    key: str
    modifier: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Rule:
    title: str
    level: str
    rule_id: str
    description: str
    condition: str
    selections: dict[str, tuple[Matcher, ...]] = field(hash=False)

    @property
    def slug(self) -> str:
        return slugify(self.title)


@dataclass(frozen=True)
class RulePack:
    rules: tuple[Rule, ...]
    load_errors: tuple[tuple[str, str], ...] = ()


def slugify(title: str) -> str:
    folded = "".join(c if c.isalnum() else "_" for c in title.strip().lower())
    return re.sub("_+", "_", folded).strip("_")


def field_key(name: str) -> str:
    """The same normalization that the log reader applies to its headers."""
    return "".join(c for c in name if c.isalnum()).lower()


def _text(node: object) -> str | None:
    return None if node is None or isinstance(node, (dict, list)) else str(node)


def _matcher(selection: str, raw_field: object, node: object) -> Matcher:
    name, _, modifier = str(raw_field).partition("|")
    modifier = modifier.strip().lower()
    if modifier not in MODIFIERS:
        raise RuleError(f"unsupported field modifier '{modifier}'")
    if isinstance(node, dict):
        raise RuleError(f"field '{raw_field}' in selection '{selection}' has an unsupported value shape")
    nodes = node if isinstance(node, list) else [node]
    values = tuple("" if v is None else str(v) for v in nodes if not isinstance(v, (dict, list)))
    return Matcher(field_key(name.strip()), modifier, values)


def parse_rule(text: str) -> Rule:
    """One rule from YAML text. Scalars stay text: ``Yes`` is a word here, not a boolean."""
    root = yaml.load(text, Loader=yaml.BaseLoader)
    if not isinstance(root, dict):
        raise RuleError("no mapping at the root")
    title = _text(root.get("title"))
    if title is None:
        raise RuleError("missing 'title'")
    detection = root.get("detection")
    if not isinstance(detection, dict):
        raise RuleError(f"rule '{title}' is missing a 'detection' mapping")
    condition = _text(detection.get("condition"))
    if condition is None:
        raise RuleError(f"rule '{title}' is missing 'detection.condition'")
    selections: dict[str, tuple[Matcher, ...]] = {}
    for name, body in detection.items():
        if name in NOT_SELECTIONS:
            continue
        if not isinstance(body, dict):
            raise RuleError(f"selection '{name}' is not a field mapping")
        selections[name] = tuple(_matcher(name, f, v) for f, v in body.items())
    if not selections:
        raise RuleError(f"rule '{title}' has no selections")
    rule = Rule(
        title=title,
        level=_text(root.get("level")) or "informational",
        rule_id=_text(root.get("id")) or "",
        description=_text(root.get("description")) or "",
        condition=condition,
        selections=selections,
    )
    from ..operators.rules import condition_tree  # the condition must resolve, else the rule is refused

    condition_tree(rule)
    return rule


def load_rules(folder: str = PACK_DIR) -> RulePack:
    """All rules below a folder in path order; a broken file is reported, never fatal."""
    paths = []
    for base, _, names in os.walk(folder):
        paths += [os.path.join(base, n) for n in names if n.endswith((".yml", ".yaml"))]
    rules, errors = [], []
    for path in sorted(paths, key=str.lower):
        try:
            with open(path, encoding="utf-8") as handle:
                rules.append(parse_rule(handle.read()))
        except (RuleError, yaml.YAMLError, OSError) as problem:
            errors.append((os.path.basename(path), str(problem)))
    return RulePack(tuple(rules), tuple(errors))
