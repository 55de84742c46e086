"""Edit sessions: their states, the ways back from a failed check, and their budget; plans.sessions applies them to tables."""

from __future__ import annotations

from dataclasses import dataclass

# Stages of a session by the kind of intent.
PATHS = {
    "noop": ("parsed", "done"),
    "awaiting": ("parsed", "awaiting_answer"),
    "mechanical": ("parsed", "retrieving", "planning", "validating", "preview_ready", "done"),
    "narrative": ("parsed", "retrieving", "reasoning", "planning", "validating", "preview_ready", "done"),
    "default": ("parsed", "retrieving", "reasoning", "planning", "validating", "preview_ready", "done"),
}
ROUTES = {"retrieval": "retrieving", "story": "reasoning", "planner": "planning"}
MOST_STEPS = 50


@dataclass(frozen=True)
class Budget:
    calls: int = 24
    retries: int = 10
    seconds: float = 900.0
    dollars: float = 1.0
