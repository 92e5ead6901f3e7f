import pytest

from codelake.functions.parsing import code_chunks, symbols


def kinds(text, language):
    return [(s.name, s.kind) for s in symbols(text, language)]


@pytest.mark.parametrize(
    "text, language, expected",
    [
        ("int add(int a, int b) { return a + b; }\n", "cpp", [("add", "function")]),
        ("class Foo : public Bar { int x; void m() { if (x) { y(); } } };\nstruct S { int z; };\nclass Fwd;\n", "cpp", [("Foo", "class"), ("m", "method"), ("S", "class")]),
        ("std::string A::name() const { return n; }\nint A::size() { return 1; }\n", "cpp", [("name", "function"), ("size", "function")]),
        ("A& A::operator=(const A& o) { return *this; }\n", "cpp", [("operator=", "function")]),
        ("template <typename T> void A::put(T v) { }\n", "cpp", [("put", "function")]),
        ("void N::A::f() { }\n", "cpp", [("f", "function")]),
        ("struct P { int x; };\nenum E { a, b };\nint f(void) { for (;;) { } }\n", "c", [("P", "struct"), ("E", "enum"), ("f", "function")]),
        ("def f():\n    pass\n\nclass C:\n    def m(self):\n        def inner(): pass\n", "python", [("f", "function"), ("C", "class"), ("m", "method"), ("inner", "function")]),
        ("function f(a) { return a; }\nclass C { m() { if (a) { } } }\n", "javascript", [("f", "function"), ("C", "class"), ("m", "method")]),
        ("export interface I { a: string }\nexport function g(): void { }\n", "typescript", [("I", "interface"), ("g", "function")]),
        ("public class A { private int x; public int get() { return x; } }\ninterface B { void run(); }\n", "java", [("A", "class"), ("get", "method"), ("B", "interface"), ("run", "method")]),
        ("namespace N { public class A { public A() { } public int X { get; set; } void M() { } } }\n", "csharp", [("N", "namespace"), ("A", "class"), ("A", "constructor"), ("X", "property"), ("M", "method")]),
        ("local function f(x)\n  if x then return 1 end\nend\nfunction M.g() end\n", "lua", [("f", "function"), ("M.g", "function")]),
        ("struct S { a: i32 }\nimpl Show for S { fn show(&self) { } }\ntrait T { fn x(&self) {} }\nenum E { A }\nfn main() { }\n", "rust", [("S", "struct"), ("S", "impl"), ("show", "method"), ("T", "trait"), ("x", "method"), ("E", "enum"), ("main", "function")]),
        ("package p\n\ntype T struct { a int }\n\nfunc (t *T) M() int { return 1 }\n\nfunc f() { }\n", "go", [("T", "type"), ("M", "method"), ("f", "function")]),
        ("void shade() { float x = 1.0; } // { not a brace\n", "glsl", [("shade", "function")]),
    ],
)
def test_symbols(text, language, expected):
    assert kinds(text, language) == expected


def test_unknown_language():
    with pytest.raises(ValueError):
        symbols("x", "cobol")


def test_docs_and_spans():
    s = symbols("# about f\n# more\ndef f():\n    '''inner'''\n    return 1\n", "python")[0]
    assert s.doc == "# about f\n# more" and s.start == 17
    assert symbols("def f():\n    '''inner'''\n", "python")[0].doc == "inner"


def test_chunks():
    text = "class C:\n" + "".join(f"    def m{i}(self):\n        return {'x ' * 20}\n" for i in range(3))
    whole = code_chunks(text.replace("x x", "1 + 1"), "python", 4096)
    assert [(c["symbol_name"], c["start_line"]) for c in whole] == [(None, 1)] or len(whole) == 1
    parts = code_chunks("class C:\n" + "".join(f"    def m{i}(self):\n        return [{'1, ' * 20}]\n" for i in range(3)), "python", 30)
    assert [c["symbol_name"] for c in parts] == ["m0", "m1", "m2"] and all(c["text"].startswith("class C:\n") and c["header_lines"] == 1 for c in parts)
    assert code_chunks("", "python", 10) == []
    assert [c["window"] for c in code_chunks("a b c d e f g", "unknown", 3)] == [0, 1, 2]
