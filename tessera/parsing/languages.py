"""Languages: extensions, and the declarations that become symbols."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

KINDS = ("Function", "Method", "Class", "Struct", "Impl", "Interface")


@dataclass(frozen=True)
class Language:
    """A grammar by name, and the kind of symbol that each declaration word of it gives.

    ``kinds`` can be altered with ``with_kinds``: a word that is left out gives no symbol.
    """

    name: str
    extensions: tuple[str, ...]
    kinds: dict[str, str] = field(default_factory=dict)

    def with_kinds(self, **kinds: str | None) -> Language:
        merged = {k: v for k, v in (self.kinds | kinds).items() if v}
        if bad := set(merged.values()) - set(KINDS):
            raise ValueError(f"no such kind of symbol: {sorted(bad)}")
        return replace(self, kinds=merged)


_C = {"function": "Function", "struct": "Struct", "class": "Class", "namespace": "Class"}
LANGUAGES = (
    Language("python", ("py",), {"def": "Function", "class": "Class"}),
    Language("rust", ("rs",), {"fn": "Function", "struct": "Struct", "impl": "Impl"}),
    Language("java", ("java",), {"method": "Method", "class": "Class", "interface": "Interface", "enum": "Class"}),
    Language("c", ("c", "h"), _C),
    Language("cpp", ("cpp", "hpp", "cc", "cxx"), _C),
    Language("csharp", ("cs",), {"method": "Method", "class": "Class", "interface": "Interface", "struct": "Struct", "namespace": "Class"}),
    Language("ruby", ("rb",), {"def": "Method", "class": "Class", "module": "Class"}),
    Language("php", ("php",), {"function": "Function", "method": "Method", "class": "Class", "interface": "Interface", "trait": "Class"}),
    Language("swift", ("swift",), {"func": "Function", "class": "Class", "struct": "Struct", "protocol": "Interface", "extension": "Impl"}),
    Language("go", ("go",), {"function": "Function", "method": "Method"}),
    Language("typescript", ("ts", "tsx", "js", "jsx"), {"function": "Function", "method": "Method", "class": "Class", "interface": "Interface"}),
)
#: Extensions are told apart by case, unlike those of binary files.
BY_EXTENSION = {e: lang for lang in LANGUAGES for e in lang.extensions}


def language_of(path: str) -> Language | None:
    name = path.rpartition("/")[2]
    stem, dot, ext = name.rpartition(".")
    return BY_EXTENSION.get(ext) if stem and dot else None
