"""Condition trees over one dict of facts, by the truth table of three-valued logic: false 0, unknown 1, true 2."""

from docsheaf.operators import conditions

TABLE = {"all": min, "any": max}
NAMES = {0: False, 1: None, 2: True}


def rank(known):
    return 1 if known is None else 2 * bool(known)


def leaf(op, actual, node):
    number = conditions._as_number
    if op in conditions._COMPARE:
        sides = number(actual), number(node.get("value"))
        return None if None in sides else conditions._COMPARE[op](*sides)
    if op == "between":
        low, own, high = number(node.get("min")), number(float(actual) if isinstance(actual, bool) else actual), number(node.get("max"))
        return None if None in (low, own, high) else low <= own <= high
    listed = {"==": [node.get("value")], "in": node.get("value") or [], "not_in": node.get("value") or []}.get(op)
    return None if listed is None else (actual in listed) != (op == "not_in")


def score(node, facts, conflicts):
    op = str(node.get("op") or "").lower()
    if op in TABLE:
        return TABLE[op]((score(r, facts, conflicts) for r in node.get("rules") or []), default=1)
    if op == "not":
        return 2 - score(node.get("rule") or {}, facts, conflicts)
    actual = facts.get(node.get("field"))
    return 1 if actual is None or node.get("field") in conflicts else rank(leaf(op, actual, node))


def evaluate(node, facts, conflicts=()):
    return NAMES[score(node, facts, conflicts)]
