"""Presentation markup of formulas to infix text, and from there to what the evaluator reads.

Each element has a number of children that it must have and a writer.  Writers give text
with the strength of its weakest operator, and add parentheses only where a stronger one
takes it in; so a fraction over a power needs none, and one under a product does."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from typing import NamedTuple

#: Symbols that are spelled out, fixed values.
SPELLED = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "Δ": "Delta", "ε": "epsilon", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu",
    "ν": "nu", "π": "pi", "ρ": "rho", "σ": "sigma", "Σ": "sum", "∑": "sum", "τ": "tau", "φ": "phi", "Φ": "Phi", "χ": "chi", "ψ": "psi", "ω": "omega", "Ω": "Omega",
    "·": "*", "×": "*", "⋅": "*", "∗": "*", "−": "-", "⁢": "*", "⁡": "", "⁣": ",", "÷": "/", "∕": "/", "≤": "<=", "≥": ">=", "≠": "!=", "∞": "inf", "′": "'",
}

SUM, PRODUCT, POWER, ATOM = range(4)
_WEAKEST = (("+", SUM), ("-", SUM), ("=", SUM), ("<", SUM), (">", SUM), (",", SUM), ("*", PRODUCT), ("/", PRODUCT), ("^", POWER))


class Piece(NamedTuple):
    text: str
    strength: int = ATOM

    def within(self, strength: int) -> str:
        return self.text if self.strength >= strength else f"({self.text})"


class Malformed(ValueError):
    """An element with children that it cannot have."""


def _leaf(text: str | None) -> Piece:
    out = "".join(SPELLED.get(c, c) for c in " ".join((text or "").split()))
    return Piece(out, ATOM if re.fullmatch(r"[\w.']*", out) else SUM)


def _row(parts: list[Piece]) -> Piece:
    """Parts side by side: two operands without an operator between them are apart by a blank."""
    parts = [p for p in parts if p.text]
    if len(parts) == 1:
        return parts[0]
    out, strength, depth = "", ATOM, 0
    for p in parts:
        touching = out and (out[-1].isalnum() or out[-1] in "_')") and (p.text[0].isalnum() or (p.text[0] == "(" and not out[-1].isalpha()))
        out += " " * bool(touching) + p.text
        strength = min(strength, PRODUCT if touching and not depth else ATOM)
        if p.text in "([{":
            depth += 1
        elif p.text in ")]}":
            depth -= 1
        elif not depth:
            strength = min([strength, p.strength if p.strength < POWER and len(p.text) > 1 else ATOM, *(s for c, s in _WEAKEST if p.text == c)])
    return Piece(out, strength)


def _fenced(node: ET.Element, parts: list[Piece]) -> Piece:
    left, right = node.get("open", "("), node.get("close", ")")
    return Piece(left + ",".join(p.text for p in parts) + right, ATOM)


def _under(base: Piece, mark: Piece) -> str:
    return f"{base.within(POWER)}_{mark.text if mark.strength == ATOM else f'({mark.text})'}"


#: Element: (children it must have, or None for any number; writer of the node and its pieces).
WRITERS = {
    **dict.fromkeys(("math", "mrow", "mstyle", "mpadded", "mphantom", "merror", "semantics"), (None, lambda _, p: _row(p))),
    **dict.fromkeys(("mi", "mn", "mo", "mtext", "ms"), (0, lambda node, _: _leaf(node.text))),
    **dict.fromkeys(("mspace", "none", "mprescripts", "annotation", "annotation-xml"), (None, lambda _n, _p: Piece(""))),
    "mfrac": (2, lambda _, p: Piece(f"{p[0].within(PRODUCT)}/{p[1].within(POWER)}", PRODUCT)),
    "msup": (2, lambda _, p: Piece(f"{p[0].within(ATOM)}^{p[1].within(ATOM)}", POWER)),
    "msub": (2, lambda _, p: Piece(_under(p[0], p[1]))),
    "msubsup": (3, lambda _, p: Piece(f"{_under(p[0], p[1])}^{p[2].within(ATOM)}", POWER)),
    "munder": (2, lambda _, p: Piece(_under(p[0], p[1]))),
    "mover": (2, lambda _, p: p[0] if not p[1].text or not p[1].text[0].isalnum() else Piece(f"{p[0].within(ATOM)}^{p[1].within(ATOM)}", POWER)),
    "munderover": (3, lambda _, p: Piece(f"{_under(p[0], p[1])}^{p[2].within(ATOM)}", POWER)),
    "msqrt": (None, lambda _, p: Piece(f"sqrt({_row(p).text})")),
    "mroot": (2, lambda _, p: Piece(f"{p[0].within(ATOM)}^(1/{p[1].within(POWER)})", POWER)),
    "mfenced": (None, _fenced),
    "mtd": (None, lambda _, p: _row(p)),
    "mtr": (None, lambda _, p: Piece(", ".join(x.text for x in p), SUM)),
    "mtable": (None, lambda _, p: Piece("; ".join(x.text for x in p), SUM)),
}


def written(node: ET.Element) -> Piece:
    tag = node.tag.rsplit("}", 1)[-1]
    wants, writer = WRITERS.get(tag, (None, lambda _, p: _row(p)))
    if wants is not None and len(node) != wants:
        raise Malformed(f"{tag} has {len(node)} children")
    return writer(node, [written(child) for child in node])


def mathml(text: str | None) -> tuple[str | None, bool]:
    """(infix text, whether it could be read); what cannot keeps its words alone."""
    try:
        return written(ET.fromstring(text or "")).text, True
    except (ET.ParseError, Malformed):
        return " ".join(re.sub(r"<[^>]*>", " ", text or "").split()), False


_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_']*|[0-9]+(?:\.[0-9]+)?|\S")
CALLED = frozenset("sin cos tan asin acos atan sinh cosh tanh exp ln log log10 sqrt abs floor ceil round min max".split())


def evaluable(text: str) -> str:
    """Infix text as the evaluator reads it: products written out, differences joined to one name."""
    out: list[str] = []
    words = _WORD.findall(text)
    skip = False
    for i, word in enumerate(words):
        if skip:
            skip = False
            continue
        after = words[i + 1] if i + 1 < len(words) else ""
        if word == "Delta":
            beyond = words[i + 2] if after == "*" and i + 2 < len(words) else ""
            name = after if after[:1].isalpha() else beyond if beyond[:1].isalpha() else ""
            if name:
                words[i + 1], skip = "", True
                if name == beyond:
                    words[i + 2] = ""
                word = f"Delta_{name}"
        if not word:
            continue
        starts = word[0].isalnum() or word[0] in "_("
        ended = bool(out) and (out[-1][-1].isalnum() or out[-1][-1] in ")'_")
        if starts and ended and not (word == "(" and out[-1] in CALLED):
            out.append("*")
        out.append(word)
    return "".join(out)
