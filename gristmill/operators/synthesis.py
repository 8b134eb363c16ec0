"""Documents made from relations: typing slips, rearrangements, agreement, generation loops."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from ..functions import expr

#: Neighbouring keys of a telephone-like row layout, fixed values.
NEAR = {a: b for row in ("qwertyuiop", "asdfghjkl", "zxcvbnm") for a, b in zip(row, row[1:] + row[-2])}


def uniform(*key) -> float:
    """A number in [0, 1) from a purpose and ids: the same on every cluster."""
    return int.from_bytes(hashlib.sha256(":".join(map(str, key)).encode()).digest()[:7], "big") / 2**56


def mangle(text: str, key, rate: float = 0.3) -> tuple[str, list[str]]:
    """Independent typing slips, each with its rate; returns the text and what fired."""
    fired = []

    def does(rule: str) -> bool:
        if uniform(key, rule) < rate:
            fired.append(rule)
            return True
        return False

    place = lambda rule, n: int(uniform(key, rule, "at") * max(1, n))
    if does("lower"):
        text = text.lower()
    if does("no_end_mark"):
        text = text.rstrip("?.! ")
    if does("no_apostrophe"):
        text = text.replace("'", "")
    if does("double_blank"):
        text = text.replace(" ", "  ", 1)
    for rule in ("drop", "double", "swap", "near_key"):
        if len(text) > 3 and does(rule):
            i = 1 + place(rule, len(text) - 2)
            a, c, b = text[:i], text[i], text[i + 1 :]
            text = {"drop": a + b, "double": a + c + c + b, "swap": a[:-1] + c + a[-1] + b, "near_key": a + NEAR.get(c, c) + b}[rule]
    return text, fired


def rearrangements(formula: str) -> list[tuple[str, str]]:
    """(variable, relation solved for it) for each variable that can be isolated."""
    out = []
    for v in dict.fromkeys(expr.names(expr.parse(formula.split("=")[0])) + expr.names(expr.parse(formula.split("=")[1]))):
        try:
            solved = expr.solve(formula, v)
        except expr.Refused:
            continue
        if solved.startswith(f"{v}=") and "+-" not in solved:
            out.append((v, solved))
    return out


def agree(subject: str, plural: str, singular: str) -> str:
    """The verb form that a subject takes."""
    many = subject.rstrip().endswith("s") and not subject.rstrip().endswith(("ss", "us", "is"))
    return f"{subject} {plural if many else singular}"


def generate(step: Callable[[list[str]], str], prompt: list[str], cap: int = 90, calls: int = 8) -> list[str]:
    """Token loop that runs complete calls and injects their results.

    `step` names the next token; it may never write a result itself, so `<res>` is
    dropped; after `calls` results no more calls are run.
    """
    out, open_call, ran = list(prompt), None, 0
    for _ in range(cap):
        token = step(out)
        if token == "<res>":
            continue
        out.append(token)
        if token == "<tool>":
            open_call = len(out) - 1
        elif token == "</tool>" and open_call is not None and ran < calls:
            out += ["<res>", expr.call("".join(out[open_call:])), "</res>"]
            open_call, ran = None, ran + 1
        elif token == "<end>":
            break
    return out
