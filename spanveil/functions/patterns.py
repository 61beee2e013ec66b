"""ECMAScript regular expressions for the ``regex`` module."""

from __future__ import annotations

import regex

_DIGIT, _WORD = "0-9", "A-Za-z0-9_"
_SPACE = r"\t\n\x0b\x0c\r \xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
#: What ends a line.
_ENDS = "\\n\\r" + chr(0x2028) + chr(0x2029)
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
#: A letter without case that stands in for dotless and dotted i, which simple folding leaves alone.
STAND_IN = "ǃ"


def translate(pattern: str, flags: str = "") -> str:
    """``pattern`` with the meaning its escapes, dots and dollars have in ECMAScript."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            e = pattern[i + 1]
            i += 2
            if e in "dws":
                body = {"d": _DIGIT, "w": _WORD, "s": _SPACE}[e]
                out.append(body if in_class else f"[{body}]")
            elif e in "DWS":
                body = {"D": _DIGIT, "W": _WORD, "S": _SPACE}[e]
                if in_class:
                    raise ValueError(f"\\{e} inside a class can't be translated")
                out.append(f"[^{body}]")
            elif e in "bB" and not in_class:
                out.append(_EDGE if e == "b" else f"(?!{_EDGE})")
            elif e == "b":
                out.append(r"\x08")
            elif e == "u" and pattern[i : i + 1] == "{":
                end = pattern.index("}", i)
                out.append(regex.escape(chr(int(pattern[i + 1 : end], 16))))
                i = end + 1
            elif e == "k" and pattern[i : i + 1] == "<":
                end = pattern.index(">", i)
                out.append(f"(?P={pattern[i + 1 : end]})")
                i = end + 1
            elif e == "/":
                out.append("/")
            else:
                out.append("\\" + e)
            continue
        if in_class:
            in_class = c != "]"
            out.append("\\[" if c == "[" else c)
        elif c == "[":
            in_class = True
            out.append(c)
        elif c == "." and "s" not in flags:
            out.append(f"[^{_ENDS}]")
        elif c == "$":
            out.append(rf"(?=[{_ENDS}]|\Z)" if "m" in flags else r"\Z")
        elif c == "^" and "m" in flags:
            out.append(f"(?<![^{_ENDS}])")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def compiled(pattern: str, flags: str, rule_id: str):
    """A scanner for global matching; sticky and set-notation patterns are refused."""
    if "y" in flags:
        raise ValueError(f'Rule "{rule_id}" uses the sticky flag, which has no meaning in a global scan.')
    if "v" in flags:
        raise ValueError(f'Rule "{rule_id}" uses set notation, which is not supported.')
    mode = regex.V0 | (regex.IGNORECASE if "i" in flags else 0) | (regex.DOTALL if "s" in flags else 0)
    return regex.compile(translate(pattern, flags), mode)
