"""Source files with known metrics; see FIXTURES.md."""

F1 = """@dec(1)
def f(a: int, b=2) -> str:
    return a and b and c
"""
F2 = """def g(*args: int, **kw):
    # TODO: a
    # todo b
    s = 'TODO in string'
    print(s)
"""
F3 = """class A:
    def m(self, x: int, /, y) -> None:
        try:
            pass
        except* E:
            pass

    def n(self: 'A', z) -> int:
        if z:
            return 1
        elif z > 1:
            return 2
        def inner():
            for q in z:
                pass
        return [i for i in z if i]

    class B:
        def skipped(self): ...
"""
F4 = """def h(v):
    match v:
        case 1 if v: pass
        case _: pass
    assert v
    return 1 if v else 0
"""
F5 = """x = 1
class Empty:
    y = 2
if x:
    def hidden(): ...
"""
FILES = {"f1.py": F1, "f2.py": F2, "f3.py": F3, "f4.py": F4, "f5.py": F5}

# lineno, end, lines, statements, expressions, expression statements, complexity, parameters, coverage, todo, tokens
GOLDEN = {
    "f": (2, 3, 2, 2, 10, 0, 2, 2, 0.667, 0, 21),
    "g": (1, 5, 5, 2, 6, 1, 1, 0, 0.333, 2, 20),
    "A.m": (2, 6, 5, 2, 3, 0, 2, 3, 0.5, 0, 25),
    "A.n": (8, 16, 9, 8, 15, 0, 4, 2, 0.5, 0, 46),
    "h": (1, 6, 6, 3, 8, 0, 2, 1, 0.0, 0, 28),
}


def body(lines):
    return "".join(f"    y{i} = x + {i}\n" for i in range(lines))
