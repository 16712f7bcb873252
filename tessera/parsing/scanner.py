"""Symbols of one source text, without a grammar library.

Python is read with the standard library's ``ast`` (by indentation where the text doesn't compile), Ruby
by matching ``end``, all others by their braces: comments and strings are blanked, every ``{`` is
matched, and the words before it (since the last ``;``, ``{`` or ``}``) tell what it opens.

Offsets are bytes of the UTF-8 text.  Texts are held as Latin-1 inside, one character for each byte.
"""

from __future__ import annotations

import ast
import bisect
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

from tessera.parsing.languages import Language


@dataclass
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    body_start: int | None = None
    body_end: int | None = None
    qualified_name: str = ""


def parse(source: bytes, language: Language) -> list[Symbol]:
    """Symbols in the order of their starts, outer before inner, with qualified names."""
    text = source.decode("latin-1")
    find = {"python": _python, "ruby": _ruby}.get(language.name, _braces)
    found = [s for s in find(text, language) if s.name]
    found.sort(key=lambda s: (s.start, -s.end))
    open_: list[Symbol] = []
    for s in found:
        while open_ and open_[-1].end <= s.start:
            open_.pop()
        if not s.name.isascii():
            s.name = s.name.encode("latin-1").decode("utf-8", "replace")
        s.qualified_name = f"{open_[-1].qualified_name}.{s.name}" if open_ else s.name
        open_.append(s)
    return found


# ---------------------------------------------------------------- blanking

_STRING = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_SLASH = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_REGEX = r"(?<=[=(,:;!&|?{}\n])[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TRIPLE = r'"""(?:\\.|.)*?(?:"""|\Z)'
_CHAR = r"'(?:\\(?:[^u]|u\{?[0-9A-Fa-f]+\}?)[^'\n]{0,8}|[^'\\\n]{1,4})'"
_DIRECTIVE = r"^[ \t]*#(?:[^\n\\]|\\.)*"
_BLANKED = {
    "python": rf"#[^\n]*|'''(?:\\.|.)*?(?:'''|\Z)|{_TRIPLE}|{_STRING}|{_SINGLE}",
    "rust": rf'{_SLASH}|r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|{_CHAR}',
    "java": rf"{_SLASH}|{_TRIPLE}|{_STRING}|{_SINGLE}",
    "c": rf"{_SLASH}|{_STRING}|{_CHAR}|{_DIRECTIVE}",
    "cpp": rf'{_SLASH}|R"(?P<d>[^()\s\\]*)\(.*?\)(?P=d)"|{_STRING}|{_CHAR}|{_DIRECTIVE}',
    "csharp": rf'{_SLASH}|\$?@\$?"(?:""|[^"])*"|{_TRIPLE}|{_STRING}|{_SINGLE}|{_DIRECTIVE}',
    "ruby": rf"^=begin\b.*?(?:^=end\b[^\n]*|\Z)|#(?!\{{)[^\n]*|{_STRING}|{_SINGLE}",
    "php": rf"""<\?(?:php|=)?|\?>|{_SLASH}|#(?!\[)[^\n]*|<<<[ \t]*["']?(?P<w>\w+)["']?\n.*?^[ \t]*(?P=w)\b|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""",
    "swift": rf"{_SLASH}|{_TRIPLE}|{_STRING}",
    "go": rf"{_SLASH}|`[^`]*(?:`|\Z)|{_STRING}|{_SINGLE}",
    "typescript": rf"{_SLASH}|`(?:\\.|[^`\\])*(?:`|\Z)|{_STRING}|{_SINGLE}|{_REGEX}",
}
_BLANKED = {k: re.compile(v, re.S | re.M) for k, v in _BLANKED.items()}
_PRINTED = re.compile(r"[^\s]")
_QUOTING = re.compile(r"[/\"'`#]|=begin")  # one of them begins whatever is blanked, tags of PHP aside


def blank(text: str, language: str) -> str:
    """The text with comments and strings replaced by spaces, character for character."""
    if language != "php" and not _QUOTING.search(text):
        return text
    return _BLANKED[language].sub(lambda m: _PRINTED.sub(" ", m.group()), text)


def _body_start(text: str, at: int) -> int:
    """Where the elision begins: at the body, or right after what precedes it if a line end lies between."""
    before = at
    while before and text[before - 1].isspace():
        before -= 1
    gap = text[before:at]
    return before if "\n" in gap or "\r" in gap else at


# ---------------------------------------------------------------- braces

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|readonly|virtual|override|async|unsafe|extern|new|open|fileprivate|mutating|nonmutating|required|convenience|lazy|weak|default|native|strictfp|synchronized|indirect|ref|volatile|export|declare)\s+)*"
_NOT_NAMES = frozenset("if for while switch catch do else return new try using lock fixed foreach match when where synchronized sizeof typeof with guard defer select case func function await throw elseif unless until loop in of super this".split())
_TYPE_WORD = {
    "java": re.compile(r"(?<![\w@])(?P<w>class|interface|enum)\s+(?P<n>[\w$]+)"),
    "csharp": re.compile(r"(?<![\w@])(?P<w>class|interface|struct|namespace)\s+(?P<n>@?[\w.]+)"),
    "c": re.compile(r"(?<!\w)(?P<w>struct|class|namespace)\s+(?:(?:alignas\s*\([^)]*\)|\[\[[^\]]*\]\])\s*)*(?P<n>[A-Za-z_]\w*(?:::\w+)*)"),
    "php": re.compile(r"(?<![\w$>:])(?P<w>class|interface|trait)\s+(?P<n>\w+)"),
    "swift": re.compile(r"(?<![\w.])(?P<w>class|struct|protocol|extension)\s+(?!func\b|var\b|let\b|subscript\b)(?P<n>[\w.`]+)"),
    "typescript": re.compile(r"(?<![\w.$])(?P<w>class|interface)\s+(?P<n>[\w$]+)"),
    "rust": re.compile(r"(?<!\w)(?P<w>struct)\s+(?P<n>\w+)"),
}
_TYPE_WORD["cpp"] = _TYPE_WORD["c"]
_WORDS = {k: re.search(r"\(\?P<w>([\w|]+)\)", v.pattern)[1].split("|") for k, v in _TYPE_WORD.items()}
_RUST = re.compile(r"(?<![\w.])(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*(?P<w>fn|struct)\s+(?P<n>\w+)")
_IMPL = re.compile(r"(?<![\w.])(?:unsafe\s+)?impl\b")
_FUNC = {
    "go": re.compile(r"(?:^|\n)[ \t]*(?P<d>func\s*(?P<r>\([^)]*\))?\s*(?P<n>\w+)\s*[\[(])"),
    "swift": re.compile(r"(?<![\w.])func\s+(?P<n>\w+|[-+*/=<>!&|^~%?]+)\s*[<(]"),
    "php": re.compile(r"(?<![\w$>:])function\s+&?\s*(?P<n>\w+)\s*\("),
    "typescript": re.compile(r"(?:^|[\n;{}]|\bexport\s+(?:default\s+)?|\bdeclare\s+)[ \t]*(?P<d>(?:async\s+)?function\s+(?P<n>[\w$]+)\s*[<(])"),
}
_MODIFIED = {
    "swift": re.compile(r"(?:(?:@\w+(?:\([^)]*\))?|(?:public|private|internal|fileprivate|open)(?:\(set\))?|static|final|override|mutating|nonmutating|class|required|convenience|indirect|prefix|postfix|infix|isolated|nonisolated|dynamic|optional)\s+)*\Z"),
    "php": re.compile(r"(?:(?:#\[[^\]]*\]|public|private|protected|static|final|abstract|readonly)\s+)*\Z"),
}


_CUT, _PAREN = re.compile(r"[{};]"), re.compile(r"[()]")


def _blocks(masked: str) -> list[list]:
    """[header start, open brace or None, end] of every block and every statement that ends with ';', by the place of the brace or ';'."""
    out, stack, begin = [], [], 0
    for m in _CUT.finditer(masked):
        at = m.start()
        c = masked[at]
        if c == "{":
            stack.append(len(out))
            out.append([begin, at, len(masked)])
        elif c == "}":
            if stack:
                out[stack.pop()][2] = at + 1
        else:
            out.append([begin, None, at + 1])
        begin = at + 1
    return out


_CALLED = re.compile(r"((?:[A-Za-z_$#@~\x80-\xff][\w$\x80-\xff]*|operator\s*[^\w\s(]+)(?:\s*::\s*~?[\w\x80-\xff]+)*)\s*\Z")


def _last_call(head: str) -> tuple[int, int, int] | None:
    """Name start, name end and close of the last parenthesis group at the outer level."""
    depth, close = 0, 0
    for p in reversed(list(_PAREN.finditer(head))):
        i = p.start()
        if head[i] == ")":
            if depth == 0:
                close = i
            depth += 1
            continue
        depth -= 1
        if depth < 0:
            return None
        if depth == 0:
            before = head[:i].rstrip()
            m = _CALLED.search(before if before[-1:] != ">" else _without_generic(before))
            if m and m.group(1) not in ("throws", "throw", "noexcept", "__attribute__", "decltype", "alignas", "requires"):
                return m.start(1), m.end(1), close
    return None


def _without_generic(head: str) -> str:
    depth = 0
    for i in range(len(head) - 1, -1, -1):
        depth += (head[i] == ">") - (head[i] == "<")
        if depth == 0:
            return head[:i].rstrip()
    return head


def _outer(head: str) -> str:
    """The header without what its parentheses, brackets and angles hold."""
    if "(" not in head and "[" not in head and "<" not in head:
        return head
    out, depth = [], 0
    for c in head:
        if c in "([<":
            depth += 1
        if not depth:
            out.append(c)
        if c in ")]>" and depth:
            depth -= 1
    return "".join(out)


def _declaration(language: str, head: str, inside: str | None, has_body: bool) -> tuple[str, str, int] | None:
    """(declaration word, name, start in the header) of what a header declares."""
    if not has_body and _idle(language, head, inside):
        return None
    if language == "rust":
        for m in _IMPL.finditer(head):
            if has_body and not head[: m.start()].rstrip().endswith(("(", ",", ":", "->", "&", "=", "<")):
                return "impl", _impl_type(head[m.end() :]), m.start()
        ms = [m for m in _RUST.finditer(head) if has_body or m["w"] == "struct"]
        return (ms[0]["w"], ms[0]["n"], ms[0].start()) if ms else None
    if language == "go":
        ms = list(_FUNC["go"].finditer(head))
        return ("method" if ms[-1]["r"] else "function", ms[-1]["n"], ms[-1].start("d")) if ms and has_body else None
    lead = len(head) - len(head.lstrip())
    if any(w in head for w in _WORDS[language]) and (m := _TYPE_WORD[language].search(_same_length_outer(head))):
        if language in ("c", "cpp"):
            rest = head[m.end() :]
            if "(" not in _same_length_parens(head):
                return (m["w"], m["n"], m.start()) if has_body and not re.search(r"[=]", rest) or m["w"] == "struct" else None
        elif language == "typescript":
            if has_body and not re.search(r"\babstract\s+\Z", head[: m.start()]):
                return m["w"], m["n"], m.start()
        elif language in _MODIFIED:
            if has_body:
                return m["w"], m["n"], _back(head, m.start(), _MODIFIED[language])
        elif has_body and not (language == "java" and head[: m.start()].endswith("@")):
            return m["w"], m["n"], _plain_start(head, lead)
    if language in ("swift", "php"):
        ms = list(_FUNC[language].finditer(head))
        if not ms:
            return None
        if language == "swift":
            return ("func", ms[-1]["n"], _back(head, ms[-1].start(), _MODIFIED["swift"])) if has_body else None
        method = inside in ("class", "interface", "trait")
        return ("method" if method else "function", ms[-1]["n"], _back(head, ms[-1].start(), _MODIFIED["php"])) if has_body or method else None
    if language == "typescript":
        ms = list(_FUNC["typescript"].finditer(head))
        if ms and has_body:
            return "function", ms[-1]["n"], ms[-1].start("d")
    return _callable(language, head, inside, has_body)


def _idle(language: str, head: str, inside: str | None) -> bool:
    """Whether a statement without a body declares nothing, told at a glance."""
    if language in ("rust", "c", "cpp"):
        return "struct" not in head
    if language == "php":
        return "function" not in head
    if language in ("java", "csharp"):
        return "(" not in head or inside not in ("class", "interface", "enum", "struct")
    return language in ("go", "swift", "typescript")


_ASSIGNED, _TYPED, _BEFORE = re.compile(r"[=]\s*\Z|=>\s*\Z"), re.compile(r"\s*(?::[^=;]*)?"), re.compile(r"(?:^|[\n,;{}])[ \t]*(?P<d>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+)*\*?\s*)\Z")
_NO_FUNCTION, _AFTER = re.compile(r"=|\breturn\b"), re.compile(r"\s*(?:(?:const|volatile|noexcept|override|final|try|&|throw)\b|&{1,2}|->|:[^:]|\(|$|[A-Z_]+\b)")
_INIT, _ACCESS, _WORD, _MOD = re.compile(r"\)\s*(?:noexcept\s*)?(:)(?!:)"), re.compile(r"\b(?:public|private|protected)\s*:(?!:)"), re.compile(r"\w*"), re.compile(_MODS.rstrip("*") + "?")


def _callable(language: str, head: str, inside: str | None, has_body: bool) -> tuple[str, str, int] | None:
    """Functions and methods that are told by their parameter list alone."""
    if language == "cpp" and (init := _INIT.search(head)):
        head = head[: init.start(1)]  # what initialises members isn't the function's name
    call = _last_call(head)
    if not call:
        return None
    s, e, close = call
    name, before, after = head[s:e], head[:s], head[close + 1 :]
    if (word := _WORD.match(name)[0]) in _NOT_NAMES and word != "new" or _ASSIGNED.search(before):
        return None
    if language == "typescript":
        if not has_body or not _TYPED.fullmatch(after):
            return None
        m = _BEFORE.search(before)
        return ("method", name, s - len(before[m.start("d") :].lstrip())) if m else None
    if language in ("java", "csharp"):
        if inside not in ("class", "interface", "enum", "struct") or "=" in (outer := _outer(before)) or (not has_body and "=>" not in after and after.strip(" \n;") and not after.lstrip().startswith(("throws", "where"))):
            return None
        typed = [w for w in outer.split() if not w.startswith("@") and not _MOD.fullmatch(w + " ")]
        if not typed or typed[-1].endswith(".") or typed[0] in ("new", "return", "throw"):
            return None
        lead = len(head) - len(head.lstrip())
        return "method", name, _plain_start(head, lead)
    # C and C++: a type or a scope comes before the name, and nothing but qualifiers or initialisers after
    if not has_body or inside == "function" or _NO_FUNCTION.search(_outer(before)) or not _AFTER.match(after.strip() + "\n"):
        return None
    colon = max((m.end() for m in _ACCESS.finditer(head[:s])), default=0)
    lead = colon + len(head[colon:]) - len(head[colon:].lstrip())
    return "function", re.sub(r"\s+", "", name) if not name.startswith("operator") else name, lead


def _same_length_outer(head: str) -> str:
    """Parenthesised and angle-bracketed parts blanked, so that words in them declare nothing."""
    if "(" not in head and "<" not in head:
        return head
    out, depth = [], 0
    for c in head:
        depth += c in "(<"
        out.append(" " if depth else c)
        depth -= c in ")>" and depth > 0
    return "".join(out)


def _same_length_parens(head: str) -> str:
    return re.sub(r"(?:alignas|__attribute__)\s*\(+[^)]*\)+", "", head)


def _plain_start(head: str, lead: int) -> int:
    """Past labels and directives on lines of their own."""
    return lead


def _back(head: str, at: int, modifiers: re.Pattern) -> int:
    """Start of the modifiers right before a word."""
    lo = max(0, at - 200)
    best = at
    for m in re.finditer(r"(?:^|(?<=[\s]))\S", head[lo:at]):
        if modifiers.match(head, lo + m.start(), at):
            best = lo + m.start()
            break
    return best


def _impl_type(rest: str) -> str:
    rest = rest.strip()
    if rest.startswith("<"):
        depth = 0
        for i, c in enumerate(rest):
            depth += (c == "<") - (c == ">" and rest[i - 1] != "-")
            if not depth:
                rest = rest[i + 1 :].strip()
                break
    rest = re.split(r"\bwhere\b", rest)[0].strip()
    return re.split(r"\bfor\s+(?!<)", rest)[-1].strip()


_MACRO = re.compile(r"\w!\s*(?:\w+\s*)?\Z")


def _braces(text: str, language: Language) -> Iterator[Symbol]:
    name = language.name
    masked = blank(text, name)
    open_: list[tuple[int, str | None]] = []  # (end, declaration word) of the blocks around
    macro_end = -1  # what a Rust macro holds are tokens, not declarations
    for head, brace, end in _blocks(masked):
        at = brace if brace is not None else end - 1
        if at < macro_end:
            continue
        if name == "rust" and brace is not None and _MACRO.search(masked, max(head, brace - 200), brace):
            macro_end = end
            continue
        while open_ and open_[-1][0] <= at:
            open_.pop()
        inside = open_[-1][1] if open_ else None
        stop = brace if brace is not None else end - 1
        got = _declaration(name, masked[head:stop], inside, brace is not None)
        if brace is not None:
            open_.append((end, got[0] if got else ("block" if inside is None else _passed(inside))))
        if not got or got[0] not in language.kinds:
            continue
        word, called, start = got
        start += head
        s = Symbol(called, language.kinds[word], start, end)
        if brace is not None:
            s.body_start, s.body_end = _body_start(text, brace), end
        elif name == "rust" and (p := masked.find("(", start, end)) >= 0:
            s.body_start, s.body_end = _body_start(text, p), masked.rfind(")", start, end) + 1
        elif name == "csharp" and (p := masked.find("=>", start, end)) >= 0:
            s.body_start, s.body_end = _body_start(text, p), end - 1
        elif name in ("c", "cpp"):
            s.end = start + re.match(r"\w+\s+\w+", masked[start:]).end()
        if name == "rust" and brace is None and word == "struct" and "(" not in masked[start:end] and ";" not in masked[start:end]:
            continue
        yield s


def _passed(inside: str | None) -> str:
    """What a block that declares nothing means for the declarations in it."""
    return "block" if inside in ("class", "interface", "enum", "struct", "trait") else inside or "block"


# ---------------------------------------------------------------- Python

def _python(text: str, language: Language) -> Iterator[Symbol]:
    raw = text.encode("latin-1")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(raw.decode("utf-8"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        yield from _python_by_indentation(text, language)
        return
    lines = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]
    shift = 3 if raw.startswith(b"\xef\xbb\xbf") else 0
    place = lambda line, column: lines[line - 1] + column + (shift if line == 1 else 0)
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        todo.extend(ast.iter_child_nodes(node))
        word = "class" if isinstance(node, ast.ClassDef) else "def" if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else None
        if word not in language.kinds:
            continue
        first = node.body[0]
        at = min([place(first.lineno, first.col_offset), *(place(d.lineno, d.col_offset) - 1 for d in getattr(first, "decorator_list", ()))])
        end = place(node.end_lineno, node.end_col_offset)
        yield Symbol(node.name.encode("utf-8").decode("latin-1"), language.kinds[word], place(node.lineno, node.col_offset), end, len(text[:at].rstrip()), end)


_PY_HEAD = re.compile(r"^(?P<i>[ \t]*)(?P<d>(?:async[ \t]+)?(?P<w>def|class)[ \t]+(?P<n>[\w\x80-\xff]+))", re.M)


def _python_by_indentation(text: str, language: Language) -> Iterator[Symbol]:
    masked = blank(text, "python")
    # start, indent and printed end of the lines that aren't blank; after each the next one that is indented less
    lines = [(m.start(), m.end("i") - m.start(), m.end()) for m in re.finditer(r"^(?P<i>[ \t\f\v]*)[^\s](?:[^\n]*[^\s])?", masked, re.M)]
    starts, less, stack = [at for at, _, _ in lines], [len(lines)] * len(lines), []
    for j, (_, indent, _) in enumerate(lines):
        while stack and lines[stack[-1]][1] > indent:
            less[stack.pop()] = j
        stack.append(j)
    heads = list(_PY_HEAD.finditer(masked))
    for m, after in zip(heads, [h.start() for h in heads[1:]] + [len(masked)]):
        if m["w"] not in language.kinds:
            continue
        depth, colon = 0, -1
        for i in range(m.end(), after):  # a parenthesis that isn't closed ends before the next declaration
            c = masked[i]
            depth += (c in "([{") - (c in ")]}")
            if c == ":" and depth <= 0:
                colon = i + 1
                break
            if c == "\n" and depth <= 0:
                break
        if colon < 0:
            continue
        line_end = (masked.find("\n", colon) + 1 or len(masked) + 1) - 1
        if masked[colon:line_end].strip():
            end = colon + len(masked[colon:line_end].rstrip())
        else:
            first = j = bisect.bisect_right(starts, line_end)
            while j < len(lines) and lines[j][1] > len(m["i"]):
                j = less[j]
            end = lines[j - 1][2] if j > first else colon
        yield Symbol(m["n"], language.kinds[m["w"]], m.start("d"), end, colon if end > colon else None, end if end > colon else None)


# ---------------------------------------------------------------- Ruby

_RUBY = re.compile(
    r"(?P<open>(?:^|(?<=[;=(|]))[ \t]*(?P<k>class|module|def|if|unless|while|until|case|for|begin)\b)|(?<![\w.:@$])(?P<do>do)\b(?=[ \t]*(?:\||\n|$|;))|(?<![\w.:@$?])(?P<end>end)\b(?![?!:=])", re.M
)
_RUBY_HEAD = re.compile(r"(?:class|module)[ \t]+(?P<n>[A-Z\x80-\xff][\w:\x80-\xff]*)(?P<s>[ \t]*<[ \t]*[^\n;]+)?|def[ \t]+(?:(?:self|[A-Za-z_]\w*)\.)?(?P<m>[\w\x80-\xff]+[?!=]?|\[\]=?|[-+*/%<>=!~^&|]{1,3})(?P<p>[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)|[ \t]+[^\n;=]+)?")

_ENDLESS = re.compile(r"def[ \t]+(?:(?:self|[A-Za-z_]\w*)\.)?(?P<n>[\w\x80-\xff]+[?!]?)[ \t]*(?:\([^()\n]*\))?[ \t]*=(?![=~>])")


def _ruby(text: str, language: Language) -> Iterator[Symbol]:
    masked = blank(text, "ruby")
    stack: list[tuple[str, int]] = []
    loop_at = -1  # of the last loop word; a do on its line belongs to it
    for m in _RUBY.finditer(masked):
        if m["end"]:
            if not stack:
                continue
            word, at = stack.pop()
            if (s := _ruby_symbol(text, masked, word, at, m.start(), m.end(), language)) is not None:
                yield s
        elif m["do"]:
            if masked.find("\n", loop_at, m.start()) >= 0 or loop_at < 0:
                stack.append(("do", m.start()))
        else:
            word, at = m["k"], m.start("k")
            if word == "def" and (one := _ENDLESS.match(masked, at)):  # one expression, without an end
                if word in language.kinds:
                    line = (masked.find("\n", one.end()) + 1 or len(masked) + 1) - 1
                    end = one.end() + len(masked[one.end() : line].rstrip(" \t\r;"))
                    body = one.end() + len(masked[one.end() : end]) - len(masked[one.end() : end].lstrip())
                    if body < end:
                        yield Symbol(one["n"], language.kinds[word], at, end, body, end)
                continue
            if word in ("while", "until", "for"):
                loop_at = at
            stack.append((word, at))
    for word, at in stack:
        if (s := _ruby_symbol(text, masked, word, at, len(text), len(text), language)) is not None:
            yield s


def _ruby_symbol(text: str, masked: str, word: str, at: int, before_end: int, end: int, language: Language) -> Symbol | None:
    if word not in language.kinds:
        return None
    m = _RUBY_HEAD.match(masked, at)
    if not m:
        return None
    head = at + len(masked[at : m.end()].rstrip())
    inner = masked[head:before_end]
    s = Symbol(m["n"] or m["m"], language.kinds[word], at, end)
    if inner.strip(" \t\r\n;"):
        first = head + len(inner) - len(inner.lstrip(" \t\r\n;"))
        s.body_start, s.body_end = _body_start(text, first), head + len(inner.rstrip())
    return s
