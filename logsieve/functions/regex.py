"""User patterns are RE2 syntax; the engine's are Java's. ``java_pattern`` writes
one as the other, construct by construct, and raises where RE2 would refuse the
pattern or the meaning can't be kept."""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
# ASCII word boundary and its opposite, independent of what the text holds.
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"

# --- fixed values: named classes, as the inside of a Java class -------------
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_ESCAPED_CLASSES = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r "}
_CONTROL = {"a": r"\x07", "f": r"\f", "t": r"\t", "n": r"\n", "r": r"\r", "v": r"\x0B"}
_GENERAL_CATEGORY = re.compile(r"(?:C[cfos]?|L[lmotu]?|M[cen]?|N[dlo]?|P[cdefios]?|S[ckmo]?|Z[lps]?)\Z")


class _Reader:
    def __init__(self, pattern: str):
        self.p, self.i, self.lines = pattern, 0, False

    def bad(self, why: str):
        raise ValueError(f"invalid regex pattern {self.p!r}: {why}")

    def take(self, n: int = 1) -> str:
        out = self.p[self.i:self.i + n]
        if len(out) < n:
            self.bad("unexpected end")
        self.i += n
        return out

    def unicode_class(self, sign: str) -> str:
        if self.p[self.i:self.i + 1] == "{":
            end = self.p.find("}", self.i)
            if end < 0:
                self.bad("unclosed \\p{")
            name, self.i = self.p[self.i + 1:end], end + 1
        else:
            name = self.take()
        if name.startswith("^"):
            name, sign = name[1:], "P" if sign == "p" else "p"
        return f"\\{sign}{{{name if _GENERAL_CATEGORY.match(name) else 'Is' + name}}}"

    def escape(self, inside: bool) -> str:
        c = self.take()
        if c in _ESCAPED_CLASSES:
            return _ESCAPED_CLASSES[c] if inside else f"[{_ESCAPED_CLASSES[c]}]"
        if c.lower() in _ESCAPED_CLASSES and c.isupper():
            return f"[^{_ESCAPED_CLASSES[c.lower()]}]"
        if c in "pP":
            return self.unicode_class(c)
        if c in _CONTROL:
            return _CONTROL[c]
        if c == "x":
            m = re.compile(r"\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2}").match(self.p, self.i)
            if not m:
                self.bad("\\x needs two hex digits")
            self.i = m.end()
            return "\\x" + m[0]
        if not inside and c in "bBAzQE":
            if c == "Q":
                end = self.p.find("\\E", self.i)
                text = self.p[self.i:] if end < 0 else self.p[self.i:end]
                self.i = len(self.p) if end < 0 else end + 2
                return "".join("\\" + x if not x.isalnum() and x.isascii() else x for x in text)
            return {"b": _BOUNDARY, "B": _NO_BOUNDARY, "A": r"\A", "z": r"\z", "E": ""}[c]
        if c.isalnum() and c.isascii():
            self.bad(f"unknown escape \\{c}")
        return "\\" + c if c.isascii() else c

    def klass(self) -> str:
        out = "["
        if self.p[self.i:self.i + 1] == "^":
            out += "^"
            self.i += 1
        first = True
        while True:
            if self.p.startswith("[:", self.i):
                m = re.compile(r"\[:(\^?)(\w+):\]").match(self.p, self.i)
                if m:
                    if m[2] not in POSIX_CLASSES:
                        self.bad(f"unknown class [:{m[2]}:]")
                    out += f"[^{POSIX_CLASSES[m[2]]}]" if m[1] else POSIX_CLASSES[m[2]]
                    self.i, first = m.end(), False
                    continue
            c = self.take()
            if c == "]" and not first:
                return out + "]"
            first = False
            # these mean something else in a Java class
            out += self.escape(True) if c == "\\" else "\\" + c if c in "[]&~^#" else "\\x20" if c == " " else c

    def group(self) -> str:
        if self.p[self.i:self.i + 1] != "?":
            return "("
        self.i += 1
        m = re.compile(r"P?<([A-Za-z_]\w*)>").match(self.p, self.i)
        if m:
            self.i = m.end()
            return f"(?<{m[1].replace('_', 'U')}>"
        m = re.compile(r"([imsU]*)(?:-([imsU]+))?([:)])").match(self.p, self.i)
        if not m:
            self.bad("look-around, back-references and atomic groups are not supported")
        on, off, end = m[1], m[2] or "", m[3]
        if "U" in on + off:
            self.bad("the ungreedy flag is not supported")
        if "m" in on + off:
            if end == ":" or "m" in off or self.i > 2:
                self.bad("the multi-line flag is supported at the start of a pattern only")
            self.lines = True
        self.i = m.end()
        # Unicode folding goes with i
        flags = on.replace("i", "iu") + ("-" + off.replace("i", "iu") if off else "")
        return f"(?{flags}{end}"

    def read(self) -> str:
        out, repeated = ["(?d)"], False  # (?d): only \n ends a line
        while self.i < len(self.p):
            c = self.take()
            again = False
            if c == "\\":
                out.append(self.escape(False))
            elif c == "[":
                out.append(self.klass())
            elif c == "(":
                out.append(self.group())
            elif c == "$":
                out.append("$" if self.lines else r"\z")
            elif c in "*+?" or c == "{" and re.compile(r"\d+(?:,\d*)?\}").match(self.p, self.i):
                if c == "{":
                    m = re.compile(r"(\d+)(?:,(\d*))?\}").match(self.p, self.i)
                    if max(int(m[1]), int(m[2] or 0)) > 1000:
                        self.bad("repeat count over 1000")
                    c, self.i = "{" + m[0], m.end()
                if repeated:
                    self.bad("nested repetition")
                if self.p[self.i:self.i + 1] == "?":
                    c += self.take()
                out.append(c)
                again = True
            elif c in "{}":
                out.append("\\" + c)
            else:
                out.append(c)
            repeated = again
        return "".join(out)


def java_pattern(pattern: str) -> str:
    """``pattern`` (RE2 syntax) as a Java pattern that finds the same texts."""
    return _Reader(pattern).read()
