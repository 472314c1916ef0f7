"""Checks of a request before any data is read: plain Python, as a request is one small map."""

from __future__ import annotations

from collections.abc import Mapping


def request_errors(request: Mapping, combinations: Mapping[str, tuple[str, ...]], most_interests: int = 2) -> list[tuple[str, str]]:
    """(field, what is wrong) of a request with combination, scores and interests; none if it's sound.

    Scores are wanted for the combination's subjects alone, from 0 to 10; interests are a list
    of at most most_interests texts that aren't blank.
    """
    out = []
    name = str(request.get("combination", "")).strip().upper()
    if not name:
        out.append(("combination", "missing"))
    elif name not in combinations:
        out.append(("combination", "unsupported"))
    scores = request.get("scores") or {}
    if not scores:
        out.append(("scores", "missing"))
    elif not isinstance(scores, Mapping):
        out.append(("scores", "not a mapping"))
        scores = {}
    for subject in combinations.get(name, ()) if scores else ():
        value = scores.get(subject)
        if subject not in scores:
            out.append((f"scores.{subject}", "missing"))
        elif not isinstance(value, int | float) or not 0 <= value <= 10:
            out.append((f"scores.{subject}", "outside 0 to 10"))
    interests = request.get("interests", [])
    if not isinstance(interests, list):
        out.append(("interests", "not a list"))
    elif len(interests) > most_interests:
        out.append(("interests", "too many"))
    elif not all(isinstance(x, str) and x.strip() for x in interests):
        out.append(("interests", "blank"))
    return out


def user_score(request: Mapping, combinations: Mapping[str, tuple[str, ...]]) -> float:
    """The sum of the combination's subjects; other scores don't count."""
    return float(sum(request["scores"][s] for s in combinations[str(request["combination"]).strip().upper()]))
