"""The raster calculator's expressions, parsed to SQL text.

Binding from weak to strong: ``or``/``||``, ``and``/``&&``, comparisons, ``+``, ``-``, ``*``,
``/``, ``%``, ``^``, unary minus. So ``a - b + c`` is ``(a - b) + c`` and ``a * b / c`` is ``a * (b / c)``.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|('[^']*'|\"[^\"]*\")|(<=|>=|==|!=|&&|\|\||[-+*/%^()<>,]))")
_LEVELS = [("or", "||"), ("and", "&&"), ("<", "<=", "==", "!=", ">=", ">"), ("+",), ("-",), ("*",), ("/",), ("%",), ("^",)]
_FUNCTIONS = {"abs", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "ceil", "floor", "sign"}


class CalculatorError(ValueError):
    """The expression can't be parsed."""


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise CalculatorError(f"unexpected text at {text[at:]!r}")
        out.append(m.group().strip())
        at = m.end()
    return out


def to_sql(text: str, names: dict[str, str]) -> str:
    """SQL of an expression; ``names`` maps its rasters and variables to columns."""
    tokens = _tokens(text)

    def take(*wanted: str) -> str | None:
        return tokens.pop(0) if tokens and tokens[0].lower() in wanted else None

    def expect(what: str) -> None:
        if not take(what):
            raise CalculatorError(f"{what} expected")

    def atom() -> str:
        if not tokens:
            raise CalculatorError("unexpected end")
        t = tokens.pop(0)
        if t == "(":
            inner = level(0)
            expect(")")
            return f"({inner})"
        if t in "-+":
            return f"({t}{atom()})"
        if t[0].isdigit():
            return f"CAST({t} AS DOUBLE)"
        if t[0] in "'\"":
            t = t[1:-1]
            if t not in names:
                raise CalculatorError(f"no raster named {t}")
            return names[t]
        if take("("):
            args = []
            while not take(")"):
                args.append(level(0))
                take(",")
            return call(t.lower(), args)
        if t in names:
            return names[t]
        raise CalculatorError(f"unknown name {t}")

    def call(name: str, args: list[str]) -> str:
        if name == "e" or name == "pi":
            return "exp(CAST(1 AS DOUBLE))" if name == "e" else "pi()"
        if name in _FUNCTIONS and len(args) == 1:
            return f"{name}({args[0]})"
        if name == "int":
            return f"(sign({args[0]}) * floor(abs({args[0]})))"
        if name == "round":
            return f"round({args[0]})" if len(args) == 1 else f"(round({args[1]} / {args[0]}) * {args[0]})"
        if name == "log":
            return f"CASE WHEN {args[-1]} > 0 THEN ln({args[-1]}) / ln({args[0] if len(args) > 1 else 'CAST(10 AS DOUBLE)'}) END"
        if name in ("min", "max"):
            return f"{'least' if name == 'min' else 'greatest'}({', '.join(args)})"
        raise CalculatorError(f"unknown function {name}")

    def level(k: int) -> str:
        if k == len(_LEVELS):
            return atom()
        left = level(k + 1)
        while op := take(*_LEVELS[k]):
            right = level(k + 1)
            op = op.lower()
            if k <= 1:
                word = "OR" if k == 0 else "AND"
                left = f"(CASE WHEN {left} <> 0 {word} {right} <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
            elif k == 2:
                left = f"(CASE WHEN {left} {({'==': '=', '!=': '<>'}).get(op, op)} {right} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"
            elif op in "/%":
                left = f"(CASE WHEN {right} <> 0 THEN {left} {op} {right} END)"
            else:
                left = f"power({left}, {right})" if op == "^" else f"({left} {op} {right})"
        return left

    out = level(0)
    if tokens:
        raise CalculatorError(f"unexpected {tokens[0]!r}")
    return out
