"""Goldens of the parser: symbols and elided texts."""

import pytest

from tessera.parsing import scanner
from tessera.parsing.languages import BY_EXTENSION, LANGUAGES, language_of


def elided(raw, symbols):
    out, last = b"", 0
    for s in symbols:
        if s.body_start is not None and s.body_start >= last:
            out += raw[last : s.body_start] + b"..."
            last = s.body_end
    return (out + raw[last:]).decode()


def read(src, ext):
    raw = src.encode()
    symbols = scanner.parse(raw, BY_EXTENSION[ext])
    return [f"{s.kind} {s.qualified_name}" for s in symbols], elided(raw, symbols)


CASES = {
    "g1": ("py", "class MyClass:\n    def m(self):\n        pass", ["Class MyClass", "Function MyClass.m"], "class MyClass:..."),
    "g2": ("py", "def calculate_total(a: int) -> int:\n    return a", ["Function calculate_total"], "def calculate_total(a: int) -> int:..."),
    "g3": ("rs", "pub struct User {\n  id: u32,\n  name: String,\n}", ["Struct User"], "pub struct User ..."),
    "g4": ("rs", "pub fn f(a: i32) -> i32 {\n // } c\n a\n}", ["Function f"], "pub fn f(a: i32) -> i32 ..."),
    "g5": ("py", "class MyClass:\n    def my_method(self):\n        def nested():\n            pass\n        return 1\n", ["Class MyClass", "Function MyClass.my_method", "Function MyClass.my_method.nested"], "class MyClass:...\n"),
    "g7": ("py", "# only a comment\n", [], "# only a comment\n"),
    "g8": ("java", "public class MyClass {\n  @Override\n  public void doWork() {\n    if (x > 1) { foo(); }\n  }\n MyClass(int a) { }\n}", ["Class MyClass", "Method MyClass.doWork"], "public class MyClass ..."),
    "g9": ("c", "int calculate(int a, int b) {\n  for (;;) { }\n}\n", ["Function calculate"], "int calculate(int a, int b) ...\n"),
    "g10": ("cs", 'public class Server {\n  public async Task StartAsync() {\n    await X("}");\n  }\n  public int P { get; set; }\n}', ["Class Server", "Method Server.StartAsync"], "public class Server ..."),
    "g11": ("rb", "class User\n  def login(a)\n    if a\n      x\n    end\n    y if z\n  end\nend\n", ["Class User", "Method User.login"], "class User...\nend\n"),
    "g12": ("php", "<?php\nclass Controller {\n  public function handle($r) {\n    return 1;\n  }\n}\n", ["Class Controller", "Method Controller.handle"], "<?php\nclass Controller ...\n"),
    "g13": ("swift", 'class ViewModel {\n  func loadData() {\n    print("x")\n  }\n}', ["Class ViewModel", "Function ViewModel.loadData"], "class ViewModel ..."),
    "go": ("go", "package m\n\ntype T struct {\n A int\n}\nfunc (t *T) M() int { return 1 }\nfunc F(a int) {\n x := func() {}\n}\n", ["Method M", "Function F"], "package m\n\ntype T struct {\n A int\n}\nfunc (t *T) M() int ...\nfunc F(a int) ...\n"),
    "ts": ("ts", "export class A extends B {\n  constructor(x) { super(x); }\n  async go(a: number): Promise<void> { if (a) { x(); } }\n}\ninterface I { a: string }\nconst g = () => { run() };\n", ["Class A", "Method A.constructor", "Method A.go", "Interface I"], "export class A extends B ...\ninterface I ...\nconst g = () => { run() };\n"),
    "cpp": ("cpp", "namespace N { class A { public: int f() const { return 1; } A() : x(1) { } }; }\nint A::g(int x) { return x; }", ["Class N", "Class N.A", "Function N.A.f", "Function N.A.A", "Function A::g"], "namespace N ...\nint A::g(int x) ..."),
    "rust_impl": ("rs", "impl<T> Foo for Bar<T> {\n fn x(&self) {}\n}\nstruct P(i32);\n", ["Impl Bar<T>", "Function Bar<T>.x", "Struct P"], "impl<T> Foo for Bar<T> ...\nstruct P...;\n"),
    "php_function": ("php", "<?php\nfunction top() { return function($x) { return 1; }; }\n", ["Function top"], "<?php\nfunction top() ...\n"),
    "swift_types": ("swift", "struct S { var a: Int }\nprotocol Q { func z() }\nextension S { func q() { } }", ["Struct S", "Interface Q", "Impl S", "Function S.q"], "struct S ...\nprotocol Q ...\nextension S ..."),
    "broken_python": ("py", "def broken(:\n  pass\nclass K(object):\n    def é(self):\n        x = (1,\n", ["Class K", "Function K.é"], "def broken(:\n  pass\nclass K(object):...\n"),
    "comment_before_body": ("py", "def f():  # why\n    return 1\n", ["Function f"], "def f():  # why...\n"),
    "crlf_and_wide": ("py", "x = 'é'\r\ndef f():\r\n    return 1\r\n", ["Function f"], "x = 'é'\r\ndef f():...\r\n"),
    "unclosed": ("c", "int f(void) {\n  if (x) {\n", ["Function f"], "int f(void) ..."),
    "empty": ("java", "", [], ""),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(name):
    ext, src, symbols, text = CASES[name]
    assert read(src, ext) == (symbols, text)


def test_offsets_are_bytes():
    raw = "# é\ndef a():\n    pass\ndef b():\n    return 'ü'\n".encode()
    s = scanner.parse(raw, BY_EXTENSION["py"])
    assert [raw[x.start : x.end].decode() for x in s] == ["def a():\n    pass", "def b():\n    return 'ü'"]


def test_languages():
    assert len(LANGUAGES) == 11 and len(BY_EXTENSION) == 18
    assert language_of("a/b.PY") is None and language_of("a/.py") is None and language_of("x/y.tsx").name == "typescript"
    assert [s.kind for s in scanner.parse(b"def f():\n  pass\nclass A: x = 1\n", BY_EXTENSION["py"].with_kinds(**{"def": "Method", "class": None}))] == ["Method"]


def test_time_is_linear_where_python_does_not_compile():
    import time

    began = time.process_time()
    assert len(scanner.parse(("x = (\nclass K:\n" + "    def f(self):\n        return 1\n" * 15_000).encode(), BY_EXTENSION["py"])) == 15_001
    scanner.parse(b"def f(\n" * 20_000, BY_EXTENSION["py"])
    assert time.process_time() - began < 5


def test_endless_methods_and_macros():
    assert read("class U\n  def self.x = 1\n  def w(a) = a + 1\n  def y\n    2\n  end\nend\n", "rb")[0] == ["Class U", "Method U.x", "Method U.w", "Method U.y"]
    assert read("def w(a) = a + 1\n", "rb") == (["Method w"], "def w(a) = ...\n")
    assert read("macro_rules! m {\n  ($x:expr) => { fn inner() { } };\n}\nfn real() { m! { fn z() {} } }\n", "rs")[0] == ["Function real"]
