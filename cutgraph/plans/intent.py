"""Prompts to intents, on the driver: normalise, question test, fast paths, then a heuristic."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions import scalar

KEEP_WORDS = ("keep", "only", "focus", "show")


@dataclass(frozen=True)
class Operation:
    action: str
    query: str
    priority: str = "hard"
    confidence: float = 1.0
    negation: bool = False


@dataclass(frozen=True)
class Intent:
    prompt: str
    operations: list[Operation] = field(default_factory=list)
    question: bool = False
    target_us: int | None = None
    platform: str | None = None


def normalized(prompt: str) -> str:
    """Single spaces, without openings that mean nothing."""
    text, openings = " ".join(prompt.split()), "|".join(map(re.escape, scalar.POLITE))
    return re.sub(rf"^(?:(?:{openings})\b[\s,]*)+", "", text, flags=re.I)


def is_question(prompt: str) -> bool:
    edits = re.search(rf"\b(?:{'|'.join(scalar.EDIT_VERBS)})\b", prompt, re.I)
    return not edits and bool(prompt.endswith("?") or re.match(rf"(?:{'|'.join(scalar.ASKING)})\b", prompt, re.I))


def duration_of(prompt: str) -> int | None:
    m = re.search(r"(?:under|less than|best|to)\s+([0-9]+)(?![0-9:])\s*(seconds?|s|minutes?|min|m)?\b", prompt, re.I)
    return int(m[1]) * (60 if (m[2] or "s").lower().startswith("m") else 1) * 1_000_000 if m else None


def parse(prompt: str) -> Intent:
    """The intent of a prompt; an empty one has no operation."""
    text = normalized(prompt)
    if not text:
        return Intent(prompt)
    if is_question(text):
        return Intent(prompt, question=True)
    platform = next((p for p in ("youtube_shorts", "tiktok", "reels", "youtube") if p in text.lower().replace(" ", "_")), None)
    extra = {"target_us": duration_of(text), "platform": platform}
    clean = re.sub(r"\s*\([^)]*\)", "", text.lower().rstrip(".!")).strip()
    for action, query, pattern in scalar.FAST_PATHS:
        if m := re.search(pattern, clean):
            return Intent(prompt, [Operation(action, query.replace("$1", m[1]) if "$1" in query else query)], **extra)
    keep = any(re.search(rf"\b{w}\b", clean) for w in KEEP_WORDS)
    verbs = "|".join((*scalar.EDIT_VERBS, "only", "show"))
    rest = re.sub(rf"^(?:(?:{verbs})\s+)+", "", clean)
    negated = re.match(r"(?:everything|all) (?:but|except)\s+", rest)
    return Intent(prompt, [Operation("keep_only" if keep else "remove", rest[negated.end() :] if negated else rest, confidence=0.6, negation=bool(negated))], **extra)
