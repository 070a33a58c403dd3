"""What the lexer and the walkers need to know of each language."""

from __future__ import annotations

from dataclasses import dataclass, field

C_STYLE = (("//",), (("/*", "*/"),))
HASH = (("#",), ())


@dataclass(frozen=True)
class Language:
    ext: str
    family: str  # brace, end, python, clause, indent or jump
    comments: tuple = C_STYLE
    functions: tuple[str, ...] = ()  # keywords that begin a function; () for C-like declarators
    strings: str = "\"'"
    branches: tuple[str, ...] = ("if",)
    loops: tuple[str, ...] = ("for", "while", "foreach", "do")
    switches: tuple[str, ...] = ("switch",)
    catches: tuple[str, ...] = ("catch",)
    elifs: tuple[str, ...] = ()
    ands: tuple[str, ...] = ("&&",)
    ors: tuple[str, ...] = ("||",)
    ternary: bool = True
    jumps: tuple[str, ...] = ("goto",)
    any_case: bool = False
    openers: tuple[str, ...] = ()  # end family: further words that an end closes
    enders: tuple[str, ...] = ("end",)
    extra: dict = field(default_factory=dict, hash=False)


_WORD_OPS = {"ands": ("&&", "and"), "ors": ("||", "or")}

#: The supported languages by name, with their file extensions.
LANGUAGES = {
    "python": Language("py", "python", HASH),
    "javascript": Language("js", "brace", functions=("function",), strings="\"'`"),
    "typescript": Language("ts", "brace", functions=("function",), strings="\"'`"),
    "java": Language("java", "brace"),
    "c#": Language("cs", "brace"),
    "c++": Language("cpp", "brace"),
    "c": Language("c", "brace"),
    "go": Language("go", "brace", functions=("func",), strings="\"'`", switches=("switch", "select"), loops=("for",), ternary=False),
    "kotlin": Language("kt", "brace", functions=("fun",), switches=("when",), ternary=False),
    "scala": Language("scala", "brace", functions=("def",), switches=("match",), ternary=False, strings='"'),
    "swift": Language("swift", "brace", functions=("func", "init"), branches=("if", "guard"), loops=("for", "while", "repeat")),
    "rust": Language("rs", "brace", functions=("fn",), switches=("match",), loops=("for", "while", "loop"), ternary=False, strings='"'),
    "php": Language("php", "brace", (("//", "#"), (("/*", "*/"),)), functions=("function", "fn"), elifs=("elseif",), switches=("switch", "match"), **_WORD_OPS),
    "dart": Language("dart", "brace"),
    "groovy": Language("groovy", "brace", functions=("def",)),
    "objective-c": Language("m", "brace"),
    "perl": Language("pl", "brace", HASH, functions=("sub",), branches=("if", "unless"), elifs=("elsif",), loops=("for", "foreach", "while", "until"), **_WORD_OPS),
    "r": Language("r", "brace", HASH, functions=("function",), loops=("for", "while", "repeat"), ands=("&&", "&"), ors=("||", "|"), ternary=False, catches=()),
    "solidity": Language("sol", "brace", functions=("function", "modifier", "constructor")),
    "ruby": Language("rb", "end", HASH, functions=("def",), branches=("if", "unless"), elifs=("elsif",), loops=("for", "while", "until"), switches=("case",), catches=("rescue",), openers=("begin", "do", "class", "module"), **_WORD_OPS),
    "lua": Language("lua", "end", (("--",), (("--[[", "]]"),)), functions=("function",), elifs=("elseif",), loops=("for", "while", "repeat"), switches=(), catches=(), ands=("and",), ors=("or",), ternary=False, enders=("end", "until")),
    "julia": Language("jl", "end", (("#",), (("#=", "=#"),)), functions=("function", "macro"), elifs=("elseif",), loops=("for", "while"), switches=(), strings='"', openers=("begin", "let", "try", "struct", "module", "quote", "do")),
    "matlab": Language("m", "end", (("%",), (("%{", "%}"),)), functions=("function",), elifs=("elseif",), loops=("for", "while", "parfor"), ands=("&&", "&"), ors=("||", "|"), ternary=False, openers=("try",)),
    "fortran": Language("f90", "end", (("!",), ()), functions=("subroutine", "function"), elifs=("elseif",), loops=("do",), switches=("select",), catches=(), ands=(".and.",), ors=(".or.",), ternary=False, any_case=True, openers=("program", "module", "type", "interface")),
    "vb.net": Language("vb", "end", (("'",), ()), functions=("sub", "function"), strings='"', elifs=("elseif",), loops=("for", "while", "do"), switches=("select",), ands=("and", "andalso"), ors=("or", "orelse"), ternary=False, any_case=True, openers=("class", "module", "try", "structure", "namespace", "property"), enders=("end", "next", "loop", "wend")),
    "delphi": Language("pas", "end", (("//",), (("{", "}"), ("(*", "*)"))), functions=("procedure", "function"), strings="'", loops=("for", "while", "repeat"), switches=("case",), catches=("except",), ands=("and",), ors=("or",), ternary=False, any_case=True, openers=("begin", "try", "record"), enders=("end", "until")),
    "haskell": Language("hs", "indent", (("--",), (("{-", "-}"),)), strings='"', switches=("case",), loops=()),
    "f#": Language("fs", "indent", (("//",), (("(*", "*)"),)), strings='"', functions=("let",), switches=("match",), loops=("for", "while"), catches=("with",)),
    "prolog": Language("pl", "clause", (("%",), (("/*", "*/"),))),
    "assembly": Language("asm", "jump", ((";", "#"), (("/*", "*/"),))),
}
#: Languages whose function metrics other than cognitive complexity are counted.
CYCLOMATIC = tuple(n for n in LANGUAGES if n not in ("dart", "julia", "matlab", "groovy", "vb.net", "assembly", "haskell", "delphi", "prolog", "f#"))
