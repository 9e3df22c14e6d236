"""Options of a request: types, defaults, aliases and bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

# Words that mean yes.
YES = ("1", "true", "yes", "y", "t")


class OptionError(ValueError):
    """An option that is missing, of the wrong type or out of its bounds."""


@dataclass
class Option:
    kind: str = "str"
    default: object = None
    required: bool = False
    alias: tuple[str, ...] = ()
    minimum: float | None = None
    maximum: float | None = None
    choices: tuple = ()
    strict: bool = True
    translations: tuple[tuple[str, str], ...] = ()


#: A phrase in quotes, a bare stretch, or a quote that is never closed.
_PIECE = re.compile(r"""(?P<phrase>"[^"]*"|'[^']*')|(?P<bare>[^\s|,+"']+)|(?P<open>["'])""")


def split_list(text: str) -> list[str]:
    """The rule of ``scalars.split_ids`` on the driver: pieces between white space, ``|``, ``,`` and ``+``, phrases whole."""
    pieces = []
    for m in _PIECE.finditer(text):
        if m["open"]:
            raise OptionError(f"a quote is not closed in {text!r}")
        piece = (m["phrase"][1:-1] if m["phrase"] else m["bare"]).strip()
        pieces += [piece] if piece else []
    return pieces


_NUMBER = re.compile(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*")


def _switch(text: str) -> bool:
    """A number switches on above zero, a word if it is one for yes."""
    return float(text) > 0 if _NUMBER.fullmatch(text) else text.lower() in YES


def _whole(text: str) -> int:
    return int(float(text))


#: How a text becomes a value of each kind; the second reader is for options that are not strict.
READERS = {"str": (str, str), "int": (int, _whole), "float": (float, float), "bool": (_switch, _switch), "list": (split_list, split_list)}
#: What values that are no texts have to become.
CASTS = {"str": str, "int": int, "float": float, "list": list}


def converted(option: Option, value):
    """The value as the option's kind, after its translations; OptionError if it is none."""
    if isinstance(value, str):
        value = reduce(lambda text, rule: re.sub(rule[0], rule[1], text), option.translations, value)
        read = READERS.get(option.kind, (str, str))[not option.strict]
    else:
        read = CASTS.get(option.kind, lambda x: x)
    try:
        return read(value)
    except OptionError:
        raise
    except (TypeError, ValueError):
        raise OptionError(f"{value!r} is not of the type {option.kind}") from None


def validated(name: str, option: Option, value):
    size = len(value) if isinstance(value, (list, str)) else value
    if option.choices and not set(value if isinstance(value, list) else [value]) <= set(option.choices):
        raise OptionError(f"{name} has to be one of {', '.join(map(str, option.choices))}")
    if option.maximum is not None and size > option.maximum:
        raise OptionError(f"{name} is above {option.maximum}")
    if option.minimum is not None and size < option.minimum:
        raise OptionError(f"{name} is below {option.minimum}")
    return value


def parse(known: dict[str, Option], given: dict) -> dict:
    """The options of a request by name; unknown ones are passed over."""
    out = {}
    for name, option in known.items():
        raw = next((given[n] for n in (name, *option.alias) if n in given), None)
        if raw is None:
            if option.required:
                raise OptionError(f"{name} is missing")
            if option.default is not None:
                out[name] = option.default
            continue
        out[name] = validated(name, option, converted(option, raw))
    return out
