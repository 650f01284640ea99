"""What must hold of the rule tables; all that doesn't is listed, nothing is raised."""

from __future__ import annotations

import re
from types import ModuleType

from inkscan import rules


def faults(tables: ModuleType = rules) -> list[str]:
    out: list[str] = []
    ids = [d[0] for d in tables.DETECTORS]
    for d, category, _, weight, _, direction, rlo, rhi, elo, ehi, *corridors in tables.DETECTORS:
        out += [f"{d}: id"] * (not re.fullmatch(r"[A-Z]-\d{2}", d)) + [f"{d}: twice"] * (ids.count(d) > 1) + [f"{d}: category {category}"] * (category not in tables.CATEGORIES)
        out += [f"{d}: thresholds"] * (rlo >= rhi or elo >= ehi) + [f"{d}: corridor"] * any(a > b for a, b in corridors) + [f"{d}: direction"] * (direction not in ("up", "down")) + [f"{d}: weight"] * (weight < 0)
    advised = {a[1] for a in tables.ADVICE}
    out += [f"{d}: no advice" for d in ids if d != "D-05" and d not in advised]
    out += [f"{r}: {what}" for r, d, effort, _, _ in tables.ADVICE for what, bad in (("detector", d not in ids), ("effort", effort not in (1, 2, 3))) if bad]
    out += [f"{r}: {what}" for r, members, least, effort in tables.COMBOS for what, bad in (("members", not set(members) <= set(ids)), ("least", least < 2), ("effort", effort not in (1, 2, 3))) if bad]
    out += [f"weight of {d}" for d in tables.TEXT_WEIGHTS if d not in ids]
    for pattern in [m[0] for listed in tables.MARKERS.values() for m in listed] + tables.CHAT_MARKERS:
        try:
            re.compile(pattern)
        except re.error:
            out.append(f"pattern {pattern}")
    return out
