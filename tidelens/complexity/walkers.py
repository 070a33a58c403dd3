"""Cognitive complexity by language family.

Structural keywords add 1 and the nesting; else and else-if add 1; a run of like logical
operators adds 1, and the operands of a chain are not looked into; a labelled jump adds 1;
lambdas and nested functions add nothing and deepen the nesting; a switch counts once.
"""

from __future__ import annotations

import ast
import re
from functools import lru_cache
from typing import NamedTuple

from .languages import LANGUAGES, Language
from .lexer import NEWLINE, Token, partners, tokens


class Function(NamedTuple):
    name: str
    complexity: int
    start: int
    end: int
    parameters: int
    tokens: int


def runs(ops: list[str]) -> int:
    return sum(1 for i, o in enumerate(ops) if i == 0 or ops[i - 1] != o)


CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "foreach", "when", "match", "guard", "synchronized", "using", "lock", "sizeof", "new", "throw", "in", "await", "typeof", "unless", "until", "elsif", "elseif", "function", "repeat", "loop", "select", "fixed", "with", "assert", "try"}
#: Tokens that end an expression, so that the logical operators on both sides are two chains.
BREAKS = {";", ",", "=", "return", "?", ":", "=>", "->", "<-", ":=", "{", "}", NEWLINE}


class Brace:
    def __init__(self, toks: list[Token], lang: Language) -> None:
        self.t, self.lang, self.close = toks, lang, partners(toks)
        self.words, self.n = [t.text for t in toks], len(toks)
        self.arms: set[int] = set()  # places of the arrows of switch arms, which are no lambdas

    def text(self, i: int) -> str:
        return self.words[i] if 0 <= i < self.n else ""

    def skip(self, i: int, end: int) -> int:
        while i < end and self.text(i) == NEWLINE:
            i += 1
        return i

    def head(self, i: int, end: int) -> tuple[int, int, int]:
        """(first, last, body): the condition after a keyword and where the body begins."""
        i = self.skip(i, end)
        if self.text(i) == "(":
            j = min(self.close[i], end)
            k = self.skip(j + 1, end)
            if self.text(k) not in ("&&", "||", ".", "==", "!=") or self.lang.ext in ("js", "ts", "java", "c", "cpp", "cs"):
                return i + 1, j, j + 1
        j = i
        stops = ("{",) if self.lang.ext == "go" else ("{", ";")
        while j < end and self.text(j) not in stops:
            j = self.close[j] + 1 if self.text(j) in ("(", "[") else j + 1
        return i, min(j, end), min(j, end)

    def body(self, i: int, end: int, nest: int) -> tuple[int, int]:
        """(score, next place) of the block or single statement at i."""
        i = self.skip(i, end)
        if self.text(i) == "{":
            j = min(self.close[i], end)
            return self.block(i + 1, j, nest), j + 1
        return self.statement(i, end, nest)

    def statement(self, i: int, end: int, nest: int) -> tuple[int, int]:
        word, lang = self.text(i), self.lang
        keyword = self.text(i - 1) not in (".", "->", "?.", "::", "@")
        if self.text(i + 1) == ":" and self.text(self.skip(i + 2, end)) in lang.loops:  # a label
            return self.statement(self.skip(i + 2, end), end, nest)
        if keyword and (word in lang.branches or word in lang.elifs):
            return self.chain(i, end, nest)
        if keyword and word in lang.loops:
            score = 1 + nest
            if word in ("do", "repeat") and self.text(self.skip(i + 1, end)) == "{":
                s, j = self.body(i + 1, end, nest + 1)
                k = self.skip(j, end)
                if self.text(k) == "while":
                    a, b, j = self.head(k + 1, end)
                    s += self.expression(a, b, nest)
                return score + s, j
            a, b, j = self.head(i + 1, end)
            if word not in ("for", "foreach") or lang.ext == "go":  # Go's only loop word also begins while loops
                score += self.expression(a, b, nest)
            s, j = self.body(j, end, nest + 1)
            return score + s, j
        if keyword and word in lang.switches and self.switch_at(i, end) is not None:
            j = self.switch_at(i, end)
            k, last = j + 1, min(self.close[j], end)
            while k < last:
                if self.text(k) in ("=>", "->"):
                    self.arms.add(k)
                k = self.close[k] + 1 if self.text(k) in ("(", "[", "{") else k + 1
            return 1 + nest + self.block(j + 1, min(self.close[j], end), nest + 1), min(self.close[j], end) + 1
        if keyword and word in lang.catches:
            j = i + 1
            if self.text(self.skip(j, end)) == "(":
                j = self.close[self.skip(j, end)] + 1
            else:
                while j < end and self.text(j) not in ("{", NEWLINE):
                    j += 1
            s, j = self.body(j, end, nest + 1)
            return 1 + nest + s, j
        if keyword and word == "else" and self.text(i + 1) in ("->", "=>"):  # the last arm of a switch
            return self.simple(i + 2, end, nest) if self.text(i + 2) != "{" else self.body(i + 2, end, nest)
        if keyword and word == "else":
            s, j = self.body(i + 1, end, nest + 1)
            return 1 + s, j
        if keyword and word in lang.jumps:
            return 1, i + 2
        if word in ("break", "continue", "last", "next") and re.fullmatch(r"[@A-Za-z_]\w*", self.text(i + 1)) and self.text(i + 1) not in ("if", "unless", "case", "default", "else"):
            return 1, i + 2
        if word == "{":
            j = min(self.close[i], end)
            return self.block(i + 1, j, nest), j + 1
        return self.simple(i, end, nest)

    def switch_at(self, i: int, end: int) -> int | None:
        """The block of a switch, match or when; None if the word is none here."""
        j = i + 1
        while j < end and self.text(j) not in ("{", ";", NEWLINE):
            j = self.close[j] + 1 if self.text(j) in ("(", "[") else j + 1
        return j if self.text(j) == "{" else None

    def chain(self, i: int, end: int, nest: int) -> tuple[int, int]:
        score = 1 + nest
        a, b, j = self.head(i + 1, end)
        score += self.expression(a, b, nest)
        if self.text(i) == "guard":
            j = self.skip(j, end)
            j += self.text(j) == "else"
            s, j = self.body(j, end, nest + 1)
            return score + s, j
        s, j = self.body(j, end, nest + 1)
        score += s
        while True:
            k = self.skip(j, end)
            if self.text(k) == ";" and self.text(self.skip(k + 1, end)) == "else":
                k = self.skip(k + 1, end)
            if self.text(k) in self.lang.elifs:
                step = k + 1
            elif self.text(k) == "else" and self.text(self.skip(k + 1, end)) in self.lang.branches:
                step = self.skip(k + 1, end) + 1
            elif self.text(k) == "else":
                s, j = self.body(k + 1, end, nest + 1)
                return score + 1 + s, j
            else:
                return score, j
            a, b, j = self.head(step, end)
            s, j = self.body(j, end, nest + 1)
            score += 1 + self.expression(a, b, nest) + s

    def simple(self, i: int, end: int, nest: int) -> tuple[int, int]:
        """An expression statement, up to its ; or line end."""
        j = i
        while j < end and self.text(j) not in (";", NEWLINE, "}"):
            if j > i and self.text(j) in ("else", "catch") or (j > i and self.text(j) in self.lang.switches and self.switch_at(j, end) is not None):
                break
            j = self.close[j] + 1 if self.text(j) in ("(", "[", "{") else j + 1
        j = min(max(j, i + (self.text(i) in (";", NEWLINE, "}"))), end)
        score = self.expression(i, j, nest)
        return score, j + (self.text(j) in (";", NEWLINE)) if j > i else i + 1

    def block(self, i: int, end: int, nest: int) -> int:
        score = 0
        while i < end:
            if self.text(i) in (NEWLINE, ";", "}", ")"):
                i += 1
                continue
            s, j = self.statement(i, end, nest)
            score += s
            i = max(j, i + 1)
        return score

    def expression(self, i: int, end: int, nest: int) -> int:
        """Logical chains, ternaries, lambdas and blocks inside an expression."""
        lang, score, ops, groups = self.lang, 0, [], []

        def flush() -> None:
            nonlocal score, ops, groups
            if ops:
                score += runs(ops)
            else:
                score += sum(self.expression(a, b, nest) for a, b in groups)
            ops, groups = [], []

        deep = nest
        while i < end:
            x = self.text(i)
            if x in lang.ands:
                ops.append("&&")
            elif x in lang.ors:
                ops.append("||")
            elif x == "?" and lang.ternary and self.colon(i, end):
                flush()
                score += 1 + nest
                deep = nest + 1
                i += 1
                continue
            elif x in ("(", "["):
                groups.append((i + 1, min(self.close[i], end)))
                i = min(self.close[i], end) + 1
                continue
            elif x == "{":
                flush()
                j = min(self.close[i], end)
                before = self.text(i - 1)
                inner = nest if i - 1 in self.arms else nest + 1 if before in (")", "=>", "->", "(", ",", "=", "in") or before in lang.functions or re.fullmatch(r"\w+", before or "-") else nest
                score += self.block(i + 1, j, inner)
                i = j + 1
                continue
            elif x in BREAKS:
                flush()
            elif x in lang.branches and x == "if":
                flush()
                s, i = self.chain(i, end, deep)
                score += s
                continue
            i += 1
        flush()
        return score

    def colon(self, i: int, end: int) -> bool:
        j = i + 1
        while j < end and self.text(j) not in (";", "}"):
            if self.text(j) == ":":
                return j > i + 1
            j = self.close[j] + 1 if self.text(j) in ("(", "[", "{") else j + 1
        return False

    def functions(self) -> list[Function]:
        """Top-level functions and members; a nested function belongs to its parent."""
        out, i, n, w = [], 0, len(self.t), self.words
        while i < n:
            # nothing else begins a head
            found = self.function_at(i) if w[i] in self.lang.functions or w[i] == "=>" or (i + 1 < n and w[i + 1] == "(") else None
            if found:
                name, params, a, b = found
                size = sum(x.text != NEWLINE for x in self.t[i : b + 1])
                last = self.t[min(b, n - 1)].line
                out.append(Function(name, self.block(a, b, 0), self.t[i].line, last, params, size))
                i = b + 1
            else:
                i += 1
        return out

    def count_parameters(self, i: int) -> int:
        j = self.close[i]
        inner = [x.text for x in self.t[i + 1 : j] if x.text != NEWLINE]
        if not inner or inner == ["void"]:
            return 0
        depth, n = 0, 1
        for x in inner:
            depth += (x in "([{<") - (x in ")]}>") if len(x) == 1 else 0
            n += x == "," and depth == 0
        return n

    def function_at(self, i: int) -> tuple[str, int, int, int] | None:
        """(name, parameters, first, last) if a function's head begins at i."""
        x, n = self.text(i), len(self.t)
        if x in self.lang.functions:
            j = i + 1
            name = ""
            while j < n and self.text(j) not in ("(", "{", "=", NEWLINE):
                name = name or (self.text(j) if re.match(r"\w", self.text(j)) else "")
                j += 1
            if self.lang.ext == "go" and self.text(i + 1) == "(":  # a receiver comes first
                j = self.close[i + 1] + 1
                name = self.text(j)
                j += 1
            if self.lang.ext == "r":
                name = self.text(i - 2) if self.text(i - 1) in ("<-", "=") else ""
            params = 0
            while j < n and self.text(j) == "[":
                j = self.close[j] + 1
            if self.text(j) == "(":
                params = self.count_parameters(j)
                j = self.close[j] + 1
            while j < n and self.text(j) not in ("{", ";"):
                if self.text(j) == NEWLINE and self.text(self.skip(j, n)) != "{":
                    break
                if self.text(j) == "=" and self.lang.ext in ("kt", "scala"):
                    j = self.skip(j + 1, n)
                    break
                j = self.close[j] + 1 if self.text(j) in ("(", "[") else j + 1
            if self.text(j) == "{":
                return name or "(anonymous)", params, j + 1, min(self.close[j], n)
            if self.text(j - 1) == "=" or self.lang.ext in ("scala", "kt", "r"):
                k = j
                while k < n and self.text(k) not in (NEWLINE, ";"):
                    k = self.close[k] + 1 if self.text(k) in ("(", "[", "{") else k + 1
                return name or "(anonymous)", params, j, min(k, n)
            return None
        if self.lang.ext == "m" and x in ("-", "+") and self.text(i + 1) == "(" and (i == 0 or self.text(i - 1) in (NEWLINE, "}", ";")):
            j = i
            while j < n and self.text(j) not in ("{", ";"):
                j += 1
            if self.text(j) == "{":
                return self.text(self.close[i + 1] + 1), sum(t.text == ":" for t in self.t[i:j]), j + 1, min(self.close[j], n)
        if self.text(i + 1) == "(" and x not in CONTROL and re.fullmatch(r"[A-Za-z_~]\w*", x) and self.text(i - 1) not in (".", "->", "new", "=", "(", ",", "return", "?.", "#") and (not self.lang.functions or self.lang.ext in ("js", "ts", "groovy")):
            j = self.close[i + 1] + 1
            while j < n and (self.text(j) in ("const", "noexcept", "override", "final", "throws", "async", "where", ":", "->", ",", "::", "&", "*", "<", ">", NEWLINE) or (re.fullmatch(r"\w+", self.text(j)) and self.text(j) not in CONTROL and self.text(j - 1) in ("throws", ",", ":", "->", "::", "where", "<"))):
                j += 1
            if self.text(j) == "{":
                return x, self.count_parameters(i + 1), j + 1, min(self.close[j], n)
            if self.text(j) == "=>" and self.lang.ext in ("dart", "cs"):
                k = j + 1
                while k < n and self.text(k) != ";":
                    k += 1
                return x, self.count_parameters(i + 1), j + 1, k
        if x == "=>" and self.lang.ext in ("js", "ts") and self.text(i + 1) == "{":
            return "(anonymous)", self.count_parameters(next((k for k, c in self.close.items() if c == i - 1), i)) if self.text(i - 1) == ")" else 1, i + 2, min(self.close[i + 1], n)
        return None


class End:
    """Languages whose blocks end with a word."""

    def __init__(self, toks: list[Token], lang: Language) -> None:
        self.t, self.lang = toks, lang

    def lines(self) -> list[list[Token]]:
        """Statements: lines, cut at semicolons as well."""
        out, cur, depth = [], [], 0
        for t in self.t:
            if t.text in "([" and t.text:
                depth += 1
            elif t.text in (")", "]"):
                depth -= 1
            if (t.text == NEWLINE or t.text == ";") and depth <= 0:
                if cur:
                    out.append(cur)
                cur = []
            elif t.text != NEWLINE:
                cur.append(t)
        return [*out, cur] if cur else out

    def chains(self, line: list[Token]) -> int:
        """Runs of logical operators at the outermost depth that has any."""
        lang, levels, depth = self.lang, {}, 0
        for t in line:
            depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
            if t.text in lang.ands or t.text in lang.ors:
                levels.setdefault(depth, []).append("&&" if t.text in lang.ands else "||")
            elif t.text in (",", "=") and depth in levels:
                levels[depth].append(",")
        ops = levels[min(levels)] if levels else []
        return runs([o for o in ops if o != ","]) if "," not in ops else sum(runs(g.split()) for g in " ".join(ops).split(","))

    def functions(self) -> list[Function]:
        lang, out, stack = self.lang, [], []
        block_words = {*lang.branches, *lang.loops, *lang.switches, *lang.functions, *lang.openers}
        top = Function("", 0, 1, 1, 0, 0)
        cur, score, size = None, 0, 0
        outside = 0
        last = 1
        pas = lang.ext == "pas"
        for line in self.lines():
            words = [t.text for t in line]
            last = line[-1].line
            one_line = False
            while words and words[0] in ("public", "private", "protected", "static", "shared", "async", "recursive", "pure", "elemental", "overrides", "integer", "real", "logical", "local", "else") and len(words) > 1 and (words[0] != "else" or words[1] in lang.branches):
                if words[0] == "else":
                    words = ["elseif", *words[2:]]
                    break
                words = words[1:]
            first = words[0] if words else ""
            nest = sum(1 for s in stack if s[0] == "nest")
            add = 0
            if cur is not None:
                size += len(line)
            if first in lang.enders or (first.startswith("end") and first[3:] in block_words and lang.any_case):
                if stack:
                    kind = stack.pop()
                    if kind[0] == "fn" and cur is not None:
                        out.append(cur._replace(complexity=score, end=last, tokens=size))
                        cur, score = None, 0
                while pas and stack and stack[-1][0] == "nest" and stack[-1][1] == "single":
                    stack.pop()
                if first == "until":
                    add = self.chains(line)
            elif first in lang.functions or (lang.functions and any(w in lang.functions for w in words[:3]) and "=" in words[:3]):
                if cur is None:
                    k = next(i for i, w in enumerate(words) if w in lang.functions)
                    rest = words[k + 1 :]
                    if "=" in rest[: rest.index("(")] if "(" in rest else False:
                        rest = rest[rest.index("=") + 1 :]
                    name = next((w for w in rest if re.match(r"\w", w)), "(anonymous)")
                    params = 0
                    if "(" in rest:
                        a = rest.index("(")
                        b = rest.index(")", a) if ")" in rest[a:] else len(rest)
                        params = 0 if b == a + 1 else 1 + rest[a:b].count(",")
                    cur, score, size = top._replace(name=name, start=line[0].line, parameters=params), 0, len(line)
                    stack.append(("fn", name))
                    if pas and "begin" not in words:
                        stack[-1] = ("fn", "await")
                else:
                    stack.append(("nest", "fn"))
            elif first == "begin" and pas and stack and stack[-1] == ("fn", "await"):
                stack[-1] = ("fn", "open")
            elif first in lang.elifs or first == "elseif":
                add = 1 + self.chains(line)
            elif first == "else":
                add = 1
            elif first in lang.catches:
                add = 1 + max(0, nest)
                stack_top = stack[-1] if stack else None
                if stack_top and stack_top[0] == "plain":
                    stack[-1] = ("nest", "catch")
            elif first in lang.branches or first in lang.loops or first in lang.switches:
                add = 1 + nest + (0 if first == "for" else self.chains(line))
                one_line = first in lang.branches and "end" in words or (lang.ext == "vb" and first in lang.branches and "then" in words and words[-1] != "then") or (lang.ext == "f90" and first == "if" and "then" not in words)
                if pas:
                    opens = words[-1] in ("begin", "of", "repeat") or first == "repeat"
                    stack.append(("nest", "block" if opens else "single"))
                    inner = next((i for i, w in enumerate(words) if i and w in {*lang.branches, *lang.loops, *lang.switches}), None)
                    if inner is not None:
                        add += 2 + nest
                elif not one_line:
                    stack.append(("nest", first))
            elif first in lang.openers or (words and words[-1] in ("do", "begin") and words[-1] in lang.openers) or "do" in words and "do" in lang.openers and "|" in words:
                stack.append(("nest" if first not in lang.openers or first == "do" else "plain", first))
            else:
                k = next((i for i, w in enumerate(words) if i and w in (*lang.branches, *lang.loops) and lang.ext == "rb" and words[i - 1] != "."), None)
                if k is not None and "=" in words[:k] and words[k - 1] == "=":
                    add = 1 + nest + self.chains(line)
                    stack.append(("nest", words[k]))
                elif k is not None:
                    add = 1 + nest + self.chains(line)
                else:
                    add = self.chains(line) + sum(w in lang.jumps for w in words)
                    if lang.ternary and "?" in words and ":" in words[words.index("?") :]:
                        add += 1 + nest
            if cur is not None:
                score += add
            else:
                outside += add
        if cur is not None:
            out.append(cur._replace(complexity=score, end=last, tokens=size))
        self.outside = outside
        return out


@lru_cache(maxsize=2)
def parsed(source: str) -> ast.Module:
    """The tree of a source; the gate and the walker share it: do not change it."""
    return ast.parse(source)


#: Nodes that score, and those that hold nothing that does.
_SCORED = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Match, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)
_LEAVES = (ast.Name, ast.Constant, ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop, ast.alias, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal)


class Python:
    """Python by its own grammar."""

    def __init__(self, source: str) -> None:
        self.tree = parsed(source)

    def visit_all(self, nodes: list, nest: int) -> int:
        return sum(self.visit(n, nest) for n in nodes)

    def visit(self, node: ast.AST, nest: int) -> int:
        if isinstance(node, _LEAVES):
            return 0
        if not isinstance(node, _SCORED):
            return sum([self.visit(n, nest) for n in ast.iter_child_nodes(node) if not isinstance(n, _LEAVES)])
        v = self.visit
        if isinstance(node, ast.If):
            return self.chain(node, nest, 1 + nest)
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            score = 1 + nest + (v(node.test, nest) if isinstance(node, ast.While) else 0)
            return score + self.visit_all(node.body, nest + 1) + (1 + self.visit_all(node.orelse, nest + 1) if node.orelse else 0)
        if isinstance(node, ast.Match):
            score = 1 + nest + v(node.subject, nest)
            return score + sum((v(c.guard, nest + 1) if c.guard else 0) + self.visit_all(c.body, nest + 1) for c in node.cases)
        if isinstance(node, ast.ExceptHandler):
            return 1 + nest + self.visit_all(node.body, nest + 1)
        if isinstance(node, ast.IfExp):
            return 1 + nest + v(node.test, nest + 1) + v(node.body, nest + 1) + v(node.orelse, nest + 1)
        if isinstance(node, ast.BoolOp):
            return runs(self.operators(node))
        body = node.body if isinstance(node.body, list) else [node.body]  # a function
        return self.visit_all(body, nest + 1)

    def operators(self, node: ast.BoolOp) -> list[str]:
        op = "&&" if isinstance(node.op, ast.And) else "||"
        out: list[str] = []
        for i, value in enumerate(node.values):
            if i:
                out.append(op)
            if isinstance(value, ast.BoolOp):
                out += self.operators(value)
        return out

    def chain(self, node: ast.If, nest: int, first: int) -> int:
        score = first + self.visit(node.test, nest) + self.visit_all(node.body, nest + 1)
        if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If) and node.orelse[0].col_offset == node.col_offset:
            return score + self.chain(node.orelse[0], nest, 1)
        return score + (1 + self.visit_all(node.orelse, nest + 1) if node.orelse else 0)

    def functions(self, source: str) -> list[Function]:
        out = []
        lines = source.split("\n")

        def look(nodes: list) -> None:
            for n in nodes:
                if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    a = n.args
                    number = len(a.args) + len(a.kwonlyargs) + len(a.posonlyargs) + bool(a.vararg) + bool(a.kwarg)
                    text = "\n".join(lines[n.lineno - 1 : n.end_lineno])
                    out.append(Function(n.name, self.visit_all(n.body, 0), n.lineno, n.end_lineno, number, len(re.findall(r"\w+|[^\w\s]", text))))
                elif isinstance(n, ast.ClassDef):
                    look(n.body)
                elif isinstance(n, (ast.If, ast.Try, ast.With)):
                    look(n.body)

        look(self.tree.body)
        return out


def prolog(toks: list[Token]) -> list[Function]:
    """Predicates: an if-then-else adds 1 and its nesting and 1 for the else; facts, rules and conjunctions add nothing.

    A condition that follows an else of the same parentheses adds 1 without nesting.
    """
    clauses, cur = [], []
    for i, t in enumerate(toks):
        if t.text == "." and (i + 1 == len(toks) or toks[i + 1].text == NEWLINE or toks[i + 1].column > t.column + 1):
            if cur:
                clauses.append(cur)
            cur = []
        elif t.text != NEWLINE:
            cur.append(t)
    scores: dict[str, list] = {}
    for c in [*clauses, *([cur] if cur else [])]:
        score, depth, open_ = 0, 0, []
        for t in c:
            if t.text == "(":
                open_.append(0)
            elif t.text == ")" and open_:
                depth -= open_.pop()
            elif t.text == "->":
                score += 1 + depth - (open_[-1] if open_ else 0)
                if open_ and not open_[-1]:
                    open_[-1] = 1
                    depth += 1
            elif t.text == ";" and open_ and open_[-1]:
                score += 1
            elif t.text == ";":
                score += 1
        row = scores.setdefault(c[0].text, [0, c[0].line, c[-1].line, 0])
        row[0] += score
        row[2] = c[-1].line
        row[3] += len(c)
    return [Function(n, s, a, b, 0, k) for n, (s, a, b, k) in scores.items()]


#: Branches that depend on a condition, and those that do not, of the common instruction sets.
CONDITIONAL = re.compile(r"j(?!mp$|al$|alr$|r$)[a-z]{1,5}|b(?:eq|ne|lt|le|gt|ge|hi|lo|hs|ls|cs|cc|vs|vc|mi|pl)z?|b(?:lt|le|gt|ge)u|c?bn?z|tbn?z|loop(?:n?[ez])?", re.IGNORECASE)
ALWAYS = re.compile(r"jmp|b|j", re.IGNORECASE)


def _instructions(toks: list[Token]) -> list[tuple[list[str], str, str, int, int]]:
    """(labels before it, mnemonic, target, line, tokens) of each instruction; one without a mnemonic ends a source with labels."""
    out, labels, line, size = [], [], [], 0
    for t in [*toks, Token(NEWLINE, 0, 0)]:
        if t.text != NEWLINE:
            line.append(t)
            continue
        at = line[0].line if line else 0
        size += len(line)
        texts = [t.text for t in line]
        while ":" in texts[:4] and all(re.fullmatch(r"[\w.$@]+", x) for x in texts[: texts.index(":")]):
            labels.append("".join(texts[: texts.index(":")]))
            texts = texts[texts.index(":") + 1 :]
        if texts:
            last = len(texts) - texts[::-1].index(",") if "," in texts else 1
            out.append((labels, texts[0], "".join(texts[last:]), at, size))
            labels, size = [], 0
        line = []
    if labels:
        out.append((labels, "", "", out[-1][3] + 1 if out else 1, size))
    return out


def assembly(toks: list[Token]) -> list[Function]:
    """Structures read off the jumps of each function.

    A conditional jump back is a loop, one ahead an if: each adds 1 and the loops, ifs and elses that it lies in.
    More jumps of one row of comparisons to one place add 1 each. A jump that always happens adds 1: as an else
    where it stands before an if's end, or else as a goto. Labels of their own begin functions.
    """
    code = _instructions(toks)
    jumped = {target for _, word, target, _, _ in code if CONDITIONAL.fullmatch(word)}
    begins = [i for i, (labels, *_) in enumerate(code) if any(not re.match(r"[.\d]|L\d", x) and x not in jumped for x in labels)]
    out = []
    for lo, hi in zip([0, *begins], [*begins, len(code)], strict=True):
        part = code[lo:hi]
        if not part:
            continue
        place = {x: i for i, (labels, *_) in enumerate(part) for x in labels}
        jumps = [(i, place.get(target, -1), bool(CONDITIONAL.fullmatch(word))) for i, (_, word, target, _, _) in enumerate(part) if CONDITIONAL.fullmatch(word) or ALWAYS.fullmatch(word)]
        loops = [(to, i) for i, to, when in jumps if when and 0 <= to <= i]
        score, ifs, elses, before = 0, [], [], None
        for i, to, when in jumps:
            if not when or 0 <= to <= i:
                continue
            if before and before[1] == to and i - before[0] <= 2:
                score += 1  # one more condition of the same if
            elif all(to <= end for start, end in loops if start <= i <= end):
                ifs.append((i, to if to >= 0 else i))
            else:
                score += 1 + sum(start <= i <= end for start, end in loops)  # leaves a loop
            before = (i, to)
        for i, to, when in jumps:
            if not when:
                score += 1
                if to > i and any(end == i + 1 for _, end in ifs):
                    elses.append((i, to))
        around = lambda i: sum(start < i < end for start, end in [*ifs, *elses])
        score += sum(1 + around(i) + sum(start <= i <= end for start, end in loops) for i, _ in ifs)
        score += sum(1 + around(start) + sum(a <= start and end <= b and (a, b) != (start, end) for a, b in loops) for start, end in loops)
        names = [x for x in part[0][0] if x not in jumped]
        out.append(Function(names[-1] if names else "(top)", score, part[0][3], part[-1][3], 0, sum(p[4] for p in part)))
    return out


def by_indent(toks: list[Token], lang: Language) -> list[Function]:
    """Definitions at the left margin; nesting follows the keywords that are open by column."""
    rows, cur, open_ = [], None, []
    start_of_line, ops = True, []
    for i, t in enumerate(toks):
        if t.text == NEWLINE:
            start_of_line = True
            if cur:
                cur[1] += runs(ops)
            ops = []
            continue
        if start_of_line:
            if t.column == 0 and re.match(r"[a-z_]", t.text) and t.text not in ("import", "module", "data", "type", "open", "where", "namespace"):
                name = toks[i + 1].text if t.text in ("let",) and i + 1 < len(toks) else t.text
                if name == "rec" and i + 2 < len(toks):
                    name = toks[i + 2].text
                if cur is None or cur[0] != name:
                    if cur:
                        rows.append(cur)
                    cur = [name, 0, t.line, t.line, 0]
                open_ = []
            arm = t.text == "|" and lang.ext == "fs"  # the arms of a match stand below its word
            open_ = [c for c in open_ if c < t.column + arm]
        if cur is None:
            cur = ["(top)", 0, t.line, t.line, 0]
        if t.text in ("if", *lang.switches, *lang.loops):
            cur[1] += 1 + len(open_) if not (t.text == "if" and i and toks[i - 1].text == "else") else 0
            open_.append(t.column)
        elif t.text in ("else", "elif"):
            cur[1] += 1
        elif t.text == "|" and start_of_line and lang.ext == "hs":
            cur[1] += 1
        elif t.text in ("&&", "||"):
            ops.append(t.text)
        start_of_line = False
        cur[3], cur[4] = t.line, cur[4] + 1
    if cur:
        cur[1] += runs(ops)
        rows.append(cur)
    return [Function(n, s, a, b, 0, k) for n, s, a, b, k in rows]


def cognitive(source: str, language: str) -> list[Function]:
    """Functions of a source; without any, one row for the whole source if it scores above 0."""
    lang = LANGUAGES[language]
    if lang.family == "python":
        p = Python(source)
        found = p.functions(source)
        if found:
            return found
        rest, size = p.visit_all(p.tree.body, 0), len(re.findall(r"\w+|[^\w\s]", source))
    else:
        toks = tokens(source, language)
        size = sum(t.text != NEWLINE for t in toks)
        if lang.family == "brace":
            b = Brace(toks, lang)
            found = b.functions()
            rest = 0 if found else b.block(0, len(toks), 0)
        elif lang.family == "end":
            e = End(toks, lang)
            found = e.functions()
            rest = 0 if found else e.outside
        else:
            found = {"clause": prolog, "jump": assembly}[lang.family](toks) if lang.family != "indent" else by_indent(toks, lang)
            rest = 0
        if found:
            return found
    return [Function("(top)", rest, 1, source.count("\n") + 1, 0, size)] if rest > 0 else []
