import random

from plumbline.frontend.facts import parse_file, split_imports
from plumbline.frontend.lexer import clone_tokens


def metrics(source):
    return {f["name"]: f for f in parse_file("A.java", source)["functions"]}


def test_cyclomatic_counts_each_branch():
    # One, then: do, foreach, conditional, three named cases (one of two labels), two logical operators, two handlers.
    f = metrics("""class Ledger {
  long settle(java.util.List<Item> open, String mode, boolean strict) {
    long sum = 0;
    do { for (Item each : open) sum += each.due() ? each.cents() : 0; } while (strict || sum < 0 && mode != null);
    switch (mode) { case "eu" -> sum += 2; case "us", "ca" -> sum += 3; case "jp" -> sum++; default -> {} }
    try { post(sum); } catch (Late late) { sum--; } catch (Refused | Lost gone) { sum = 0; } finally { close(); }
    return sum;
  }
}""")["settle"]
    assert (f["cyclomatic"], f["param_count"]) == (11, 3)


def test_cognitive_charges_for_depth():
    # for at the top 1, switch in it 2, while in the switch 3.
    assert metrics("class Grid { void paint(int[] rows) { for (int r : rows) { switch (r) { case 0: while (busy()) { rest(); } } } } }")["paint"]["cognitive"] == 6


def test_structures_that_are_a_body_or_condition_are_not_counted():
    assert metrics("class A { void n() { if (a) if (b) c(); } }")["n"]["cognitive"] == 1
    assert metrics("class A { void n() { while (a) for (;;) { } } }")["n"]["cognitive"] == 1
    assert metrics("class A { void n() { for (; a && b; ) { } } }")["n"]["cognitive"] == 1
    assert metrics("class A { void n() { while (a && b) { } } }")["n"]["cognitive"] == 2
    assert metrics("class A { int n() { return a ? b ? 1 : 2 : 3; } }")["n"]["cognitive"] == 1
    assert metrics("class A { void n() { o: for (;;) { if (x) { continue o; } } } }")["n"]["cognitive"] == 4
    assert metrics("class A { void n() { o: for (;;) { if (x) continue o; } } }")["n"]["cognitive"] == 3
    assert metrics("class A { void n() { if (a) { } else if (b) { } else { } } }")["n"]["cognitive"] == 3
    assert metrics("class A { boolean n() { return a && b || c && d; } }")["n"]["cognitive"] == 3


def test_lambda_has_its_own_row():
    assert metrics("class A { Runnable r = () -> {\n int a = 1;\n}; }")["<lambda>"]["line_count"] == 3


def test_names_and_types():
    r = parse_file("B.java", "package p.q;\nimport a.B; import static c.D.*; import static e.F.g; import h.*;\n@Service public class X extends Y<Z> { public void f(W w) {} @Override public void g() {} protected void h() {} void i() {} public static void main(String[] a) {} static class N {} }")
    assert (r["package"], r["imports"], r["wildcard_imports"], r["static_imports"]) == ("p.q", ["a.B"], ["c.D", "h"], ["e.F.g"])
    assert [t["fqn"] for t in r["types"]] == ["p.q.X", "p.q.X.N"]
    assert [e["name"] for e in r["exports"]] == ["f", "h"]
    assert {"Y", "Z", "W", "Service"} <= set(r["referenced"]) and "X" not in r["referenced"]
    assert {"X", "f", "w"} <= set(r["used_names"])


def test_static_wildcard_is_a_wildcard():
    assert split_imports(["static a.B.*", "static a.B.c", "x.Y"]) == (["x.Y"], ["a.B"], ["a.B.c"])


def test_clone_tokens_skip_comments_and_join_literals():
    assert [k for k, _ in clone_tokens('a /* b */ = "c d"; // e\nX.class')] == ["id:a", "=", 'literal:"c d"', ";", "literal:X.class"]


def test_any_input_is_survived():
    words = "class A { } ( ) ; if else for while do switch case default -> : ? < > >> , . @ x y int new return \"s\" 1 && || = try catch instanceof record enum [ ] + - ! ::".split()
    rng = random.Random(3)
    for _ in range(1500):
        parse_file("x", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))


def body(text):
    return "class A { int n(int a) { " + text + " } int last() { return a && b ? 1 : 2; } }"


def test_nesting_has_no_limit():
    assert metrics(body("return " + "(" * 4000 + "a" + ")" * 4000 + ";"))["n"]["cyclomatic"] == 1
    assert metrics(body("{" * 5000 + "if (a) { }" + "}" * 5000))["n"]["cognitive"] == 1
    assert metrics(body("return " + " && ".join(["a"] * 30_000) + ";"))["n"]["cyclomatic"] == 30_000
    assert metrics(body("".join(f"if (a == {i}) {{ }} else " for i in range(5000)) + "{ }"))["n"]["cognitive"] == 5001
    assert metrics(body("return " + "".join(f"a == {i} ? {i} : " for i in range(4000)) + "0;"))["n"]["cyclomatic"] == 4001
    deep = metrics(body("if (a) { " * 3000 + "}" * 3000))
    assert (deep["n"]["cognitive"], deep["last"]["cognitive"]) == (min(3000 * 3001 // 2, 65535), 1)
    assert metrics("class A { int n() { " + "class B { int m() { " * 1500 + "} }" * 1500 + " } }")["n"]["line_count"] == 1


def test_a_file_beyond_all_measure_has_a_row():
    row = parse_file("x", "package p; class A { int n() { return " + "(" * 100_000 + "; } }\n")
    assert (row["functions"], row["types"], row["line_count"]) == ([], [], 2) and "A" in row["used_names"]


def test_lambdas_in_parentheses():
    found = parse_file("x", "class A { void n() { f((a, b) -> a, (c), () -> { if (d) { } }); g((x) + (y)); } }")["functions"]
    assert sorted((f["name"], f["param_count"]) for f in found) == [("<lambda>", 0), ("<lambda>", 2), ("n", 0)]
