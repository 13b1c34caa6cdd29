"""Generated task rows. Every draw is a hash of (seed, name, row id): rows can be produced in any
partitioning, on any number of executors, and come out the same. The id column comes from any
table, or from ``spark.range`` for free-standing sets."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmill.operators.sample import order_key, uniform


def constants(values: Sequence, kind: str = "") -> Column:
    """An array of constants, folded into one literal when the plan is made; building it takes one call, not one per value."""
    return F.from_json(F.lit(json.dumps(list(values), ensure_ascii=False)), kind or f"array<{'string' if isinstance(values[0], str) else 'bigint'}>")


class Draw:
    """Seeded draws for one id column."""

    def __init__(self, seed, key: str):
        self.seed, self.key = seed, key

    def bits(self, name: str) -> Column:
        return order_key(self.seed, F.lit(name), self.key)

    def below(self, name: str, n: int) -> Column:
        return F.conv(F.substring(self.bits(name), 1, 8), 16, 10).cast("long") % n

    def between(self, name: str, lo: int, hi: int) -> Column:
        return self.below(name, hi - lo + 1) + lo

    def choice(self, name: str, items: Sequence) -> Column:
        return F.element_at(constants(items), (self.below(name, len(items)) + 1).cast("int"))

    def chance(self, name: str) -> Column:
        return uniform(self.bits(name))


def text(*parts) -> Column:
    """Concatenate literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def item(prompt: Column, reason: Column, answer: Column, category: str) -> Column:
    return F.struct(
        prompt.alias("input"),
        F.concat(F.lit("이유: "), reason, F.lit("\n답: "), answer).alias("output"),
        F.lit(category).alias("category"),
        answer.alias("final_answer"),
    )


def let(values: dict[str, Column], body) -> Column:
    """``body`` of named values that are worked out once a row; a column that stands in an arm of a CASE is worked out wherever it is used."""
    once = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.transform(once, lambda s: body(*[s[k] for k in values]))[0]


def orders_of(letters: str) -> list[str]:
    """All ordered picks of three letters."""
    return ["".join(p) for p in permutations(letters, 3)]


def compare_smallest(d: Draw) -> Column:
    return let({"p": d.choice("names", orders_of("ABCD"))}, _compared)


def _compared(p: Column) -> Column:
    a, b, c = (F.substring(p, i, 1) for i in (1, 2, 3))
    return item(text(a, "는 ", b, "보다 크고, ", b, "는 ", c, "보다 크다. 가장 작은 것은 누구인가?"),
                text(a, " > ", b, " > ", c, " 이므로 가장 작은 것은 ", c, "입니다."), c, "compare_smallest")


def reduced(num: Column, den: Column, top: int = 12) -> Column:
    g = F.array_max(F.filter(F.sequence(F.lit(1), F.lit(top)), lambda x: (num % x == 0) & (den % x == 0)))
    n, m = (num / g).cast("long"), (den / g).cast("long")
    return F.when(m == 1, n.cast("string")).otherwise(text(n, "/", m))


def probability(d: Draw) -> Column:
    return let({"red": d.between("red", 1, 6), "blue": d.between("blue", 1, 6)}, lambda red, blue: let({"red": red, "blue": blue, "total": red + blue, "ans": reduced(blue, red + blue)}, _drawn))


def _drawn(red: Column, blue: Column, total: Column, ans: Column) -> Column:
    return item(text("주머니에 빨간 공 ", red, "개와 파란 공 ", blue, "개가 있다. 하나를 무작위로 뽑을 때 파란 공일 확률은?"),
                text("전체 ", total, "개 중 파란 공이 ", blue, "개이므로 확률은 ", blue, "/", total, "이고 기약분수는 ", ans, "입니다."), ans, "probability")


def sequence_rule(d: Draw) -> Column:
    """x mul, + add, x mul, + add, x mul; the next step adds."""
    return let({"mul": d.choice("mul", [2, 3]).cast("long"), "add": d.between("add", 1, 5), "start": d.between("start", 2, 12)}, _alternating)


def _alternating(mul: Column, add: Column, start: Column) -> Column:
    xs = [start]
    for i in range(5):
        xs.append(xs[-1] * mul if i % 2 == 0 else xs[-1] + add)
    shown = F.concat_ws(", ", *[x.cast("string") for x in xs])
    nxt = (xs[-1] + add).cast("string")
    return item(text("수열 ", shown, ", ? 다음 수를 규칙 기반으로 설명하고 답하라."), text("규칙이 번갈아 ×", mul, ", +", add, " 이므로 다음 수는 ", nxt, "입니다."), nxt, "sequence")


def sequence_open_parts() -> tuple[str, str, str]:
    """Prompt, reason and answer of the fixed ambiguous case."""
    return "2, 6, 7, 21, 23, 69, ? 다음 수는?", "가능한 규칙이 여러 개라 다음 수를 하나로 단정할 수 없습니다.", "알 수 없음"


def sequence_open() -> Column:
    return item(*[F.lit(x) for x in sequence_open_parts()], "sequence")


def sequences(df: DataFrame, key: str, seed, one_in: int = 8) -> DataFrame:
    """Sequence rows for the ids of ``df``; one in so many is the ambiguous case."""
    d = Draw(seed, key)
    return df.select(key, F.when(d.below("open", one_in) == 0, sequence_open()).otherwise(sequence_rule(d)).alias("_i")).select(key, "_i.*")


def syllogism(d: Draw) -> Column:
    return let({"p": d.choice("terms", orders_of("ABCDE")), "yes": d.below("mode", 2) == 0}, _concluded)


def _concluded(p: Column, yes: Column) -> Column:
    a, b, c = (F.substring(p, i, 1) for i in (1, 2, 3))
    q1 = text("모든 ", a, "는 ", b, "다. 모든 ", b, "는 ", c, "다. 그러면 모든 ", a, "는 ", c, "인가?")
    r1 = text(a, "가 모두 ", b, "에 포함되고 ", b, "가 모두 ", c, "에 포함되므로 예입니다.")
    q2 = text("모든 ", a, "는 ", b, "다. 어떤 ", b, "는 ", c, "다. 그러면 어떤 ", a, "는 ", c, "인가?")
    r2 = text(b, " 일부가 ", c, "라는 정보만으로 그 대상이 ", a, "인지 알 수 없어 보장할 수 없습니다.")
    return item(F.when(yes, q1).otherwise(q2), F.when(yes, r1).otherwise(r2), F.when(yes, "예").otherwise("알 수 없음"), "syllogism")


# Premise pairs of the yes/no relation task (premises, question subject, answer, reason).
RELATIONS = (
    ("모든 고양이는 동물이다. 나비는 고양이다.", "나비는 동물이다", "예", "나비가 고양이고 모든 고양이가 동물이므로 나비는 동물입니다."),
    ("모든 포유류는 동물이다. 고래는 포유류다.", "고래는 동물이다", "예", "고래가 포유류이고 모든 포유류가 동물이므로 고래는 동물입니다."),
    ("모든 새는 동물이다. 펭귄은 새다.", "펭귄은 동물이다", "예", "펭귄이 새이고 모든 새가 동물이므로 펭귄은 동물입니다."),
    ("모든 고양이는 동물이다. 나비는 동물이다.", "나비는 고양이다", "아니오", "동물이라는 사실만으로 고양이라고 결론낼 수 없으므로 참이라고 볼 수 없습니다."),
    ("모든 포유류는 동물이다. 참새는 동물이다.", "참새는 포유류다", "아니오", "동물이라는 사실만으로 포유류라고 단정할 수 없으므로 참이라고 볼 수 없습니다."),
)


def relation(d: Draw) -> Column:
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("pqar", r)]) for r in RELATIONS])
    picked = F.element_at(rows, (d.below("item", len(RELATIONS)) + 1).cast("int"))
    return let({"r": picked}, lambda r: item(text(r["p"], " 위 두 문장을 함께 보면 '", r["q"], "'가 참인가? 예/아니오로 답하라."), r["r"], r["a"], "sentence_relation_yesno"))


# ------------------------------------------------------------------ arithmetic

# Prompt endings, place names, answer modes.
LAST_PLAIN, LAST_FINAL, LAST_STEPS = "마지막 줄에 답만 써라.", "마지막 줄에 최종답만 써라.", "짧게 풀이하고 마지막 줄에 답만 써라."
PLACES = ("일의 자리", "십의 자리", "백의 자리", "천의 자리")
STEP_PREFIX = "풀이: "

ARITHMETIC_KINDS = (
    "addsub_d1", "add_carry_d2", "sub_borrow_d2", "add_carry_d3", "sub_borrow_d3", "add_carry_d4", "sub_borrow_d4", "mul_1x1", "mul_2x1",
    "mul_2x2_easy", "mul_2x2_hard", "div_2by1_easy", "div_3by1_easy",
)


def _place(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PLACES]), (i + 1).cast("int"))


def _power(i: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), i)).cast("long")


def _whole(digits: int | Column) -> Column:
    return F.lit(digits) if isinstance(digits, int) else digits


def add_steps(a: Column, b: Column, digits: int | Column) -> Column:
    """One line per place; the carry into a place is read off the lower digits directly."""
    def line(i):
        p = _power(i)
        da, db = F.floor(a / p) % 10, F.floor(b / p) % 10
        carry = F.when((a % p) + (b % p) >= p, 1).otherwise(0)
        total = da + db + carry
        up = F.floor(total / 10)
        return F.concat(_place(i), F.lit(": "), da.cast("string"), F.lit("+"), db.cast("string"), F.when(carry > 0, "+올림 1").otherwise(""), F.lit("="), total.cast("string"),
                        F.when(up > 0, F.concat(F.lit(", "), (total % 10).cast("string"), F.lit("를 쓰고 1 올림"))).otherwise(F.concat(F.lit(", "), total.cast("string"), F.lit("를 쓴다"))))

    body = F.transform(F.sequence(F.lit(0), _whole(digits) - 1), line)
    return F.concat(body, F.when(a + b >= _power(_whole(digits)), F.array(F.lit("남은 올림 1을 앞에 붙인다"))).otherwise(F.array().cast("array<string>")))


def sub_steps(a: Column, b: Column, digits: int | Column) -> Column:
    def line(i):
        p = _power(i)
        da, db = F.floor(a / p) % 10, F.floor(b / p) % 10
        owed = F.when((a % p) < (b % p), 1).otherwise(0)
        cur = da - owed
        head = F.concat(_place(i), F.lit(": "), da.cast("string"), F.when(owed > 0, "-빌림 1").otherwise(""))
        low = F.concat(F.lit("가 "), db.cast("string"), F.lit("보다 작아 10을 빌려 "), (cur + 10).cast("string"), F.lit("-"), db.cast("string"), F.lit("="), (cur + 10 - db).cast("string"))
        return F.concat(head, F.when(cur < db, low).otherwise(F.concat(F.lit("-"), db.cast("string"), F.lit("="), (cur - db).cast("string"))))

    return F.transform(F.sequence(F.lit(0), _whole(digits) - 1), line)


def mul_steps(a: Column, b: Column, digits: int) -> Column:
    def line(i):
        p = _power(i)
        d = F.floor(b / p) % 10
        first = F.concat(F.lit("부분곱1: "), a.cast("string"), F.lit("×"), d.cast("string"), F.lit("="), (a * d).cast("string"))
        other = F.concat(F.lit("부분곱"), (i + 1).cast("string"), F.lit(": "), a.cast("string"), F.lit("×"), d.cast("string"), F.lit("×"), p.cast("string"), F.lit("="), (a * d * p).cast("string"))
        return F.when(i == 0, first).otherwise(other)

    body = F.transform(F.sequence(F.lit(0), _whole(digits) - 1), line)
    if digits == 1:
        return body
    parts = [(a * (F.floor(b / 10**i) % 10) * 10**i).cast("string") for i in range(digits)]
    return F.concat(body, F.array(F.concat(F.lit("합: "), F.concat_ws(" + ", *parts), F.lit(" = "), (a * b).cast("string"))))


def _digits(ok, low: int = 0) -> tuple[tuple[int, int], ...]:
    """Pairs of digits, the upper operand's first."""
    return tuple((x, y) for x in range(low, 10) for y in range(low, 10) if ok(x, y))


def operand_cells(kind: str) -> list[list[tuple[int, tuple[tuple[int, int], ...]]]]:
    """All operand pairs of a kind as disjoint cells: products of (factor, pairs), whose pairs times factor add up to (a, b).

    A sum with a carry has a first place, from the top, whose digits make ten: none above, any below. A difference with a
    borrow has a first place that differs and, under it, a first place whose upper digit is less.
    """
    n = int(kind[-1]) if kind[:3] in ("add", "sub") else 0
    at = lambda i, ok: (10 ** (n - 1 - i), _digits(ok, int(i == 0)))  # noqa: E731  i counts from the top, which is no zero
    if kind.startswith("add_carry"):
        return [[at(i, lambda x, y: x + y < 10) for i in range(j)] + [at(j, lambda x, y: x + y >= 10)] + [at(i, lambda x, y: True) for i in range(j + 1, n)] for j in range(n)]
    if kind.startswith("sub_borrow"):
        return [
            [at(i, lambda x, y: x == y) for i in range(j)] + [at(j, lambda x, y: x > y)] + [at(i, lambda x, y: x >= y) for i in range(j + 1, k)]
            + [at(k, lambda x, y: x < y)] + [at(i, lambda x, y: True) for i in range(k + 1, n)]
            for j in range(n) for k in range(j + 1, n)
        ]
    if kind == "mul_2x2_hard":
        hard = lambda u: tuple((a, u) for a in range(10, 100) if a % 10 * u >= 10 or a // 10 * u >= 10)
        return [[(1, hard(u)), (10, tuple((0, t) for t in range(1, 10)))] for u in range(10) if hard(u)]
    if kind.startswith("div"):
        m = int(kind[4])
        return [[(1, tuple((q * b, b) for q in range(2, 100) if len(str(q * b)) == m))] for b in range(2, 10)]
    lo, hi = {"addsub_d1": (range(10), range(10)), "mul_1x1": (range(2, 10), range(2, 10)), "mul_2x1": (range(12, 100), range(2, 10))}.get(kind, (range(10, 100), range(10, 100)))
    return [[(1, tuple((x, 0) for x in lo)), (1, tuple((0, y) for y in hi))]]


def cell_sizes(cells: list) -> list[int]:
    return [math.prod(len(t) for _, t in c) for c in cells]


#: Both operands in one number.
_PACK = 100_000


def operands(d: Draw, kind: Column, kinds: Sequence[str] = ARITHMETIC_KINDS) -> Column:
    """struct(a, b): the pair at one drawn place among all pairs of the row's kind (carry, borrow, digits), each as likely.

    The place is unranked by tables, so no draw is ever repeated: the cell by its bound, then one list after the other.
    """
    cells = [c for k in kinds for c in operand_cells(k)]
    totals = [sum(cell_sizes(operand_cells(k))) for k in kinds]
    lists = list(dict.fromkeys(t for c in cells for _, t in c)) + [((0, 0),)]
    longest = max(len(c) for c in cells)
    padded = [[(1, lists[-1])] * (longest - len(c)) + c for c in cells]
    table = constants([[x * _PACK + y for x, y in t] for t in lists], "array<array<bigint>>")
    ends = [sum(cell_sizes(cells)[: k + 1]) for k in range(len(cells))]
    which = (F.array_position(constants(kinds), kind) - 1).cast("int")
    place = F.conv(F.substring(order_key(d.seed, kind, d.key), 1, 15), 16, 10).cast("long") % F.get(constants(totals), which) + F.get(constants([sum(totals[:k]) for k in range(len(totals))]), which)

    def unranked(place: Column, cell: Column) -> Column:
        rest, packed = place - F.get(constants([e - s for e, s in zip(ends, cell_sizes(cells), strict=True)]), cell), F.lit(0)
        for i in reversed(range(longest)):
            t = F.get(table, F.get(constants([lists.index(c[i][1]) for c in padded]), cell).cast("int"))
            packed = packed + F.get(t, (rest % F.size(t)).cast("int")) * F.get(constants([c[i][0] for c in padded]), cell)
            rest = F.floor(rest / F.size(t))
        return packed

    at = F.transform(F.array(F.struct(place.alias("p"))), lambda s: F.struct(s["p"].alias("p"), F.size(F.filter(constants(ends), lambda e: e <= s["p"])).alias("c")))
    both = F.transform(at, lambda s: unranked(s["p"], s["c"]))
    return F.transform(both, lambda x: F.struct(F.floor(x / _PACK).alias("a"), (x % _PACK).alias("b")))[0]


def arithmetic(df: DataFrame, key: str, kind: str | Column, seed) -> DataFrame:
    """Arithmetic rows for the ids of ``df``: prompt style, worked steps, answer mode. ``kind`` is one of
    ``ARITHMETIC_KINDS``, or a column with one for each row, which takes one scan and one projection for all of them."""
    d = Draw(seed, key)
    kinds = [kind] if isinstance(kind, str) else list(ARITHMETIC_KINDS)
    c = F.col("category")

    def by_kind(value) -> Column:
        out = None
        for k in kinds:
            out = F.when(c == k, value(k)) if out is None else out.when(c == k, value(k))
        return out

    r = df.withColumn("category", F.lit(kind) if isinstance(kind, str) else kind).select(key, "category")
    r = r.withColumn("_o", operands(d, c, kinds)).withColumn("_op", by_kind(lambda k: F.when(d.below("op", 2) == 0, "+").otherwise("-") if k == "addsub_d1" else F.lit({"add": "+", "sub": "-", "mul": "*", "div": "/"}[k[:3]])))
    swap = (c == "addsub_d1") & (F.col("_op") == "-")
    r = r.select(key, "category", F.col("_op").alias("op"), F.when(swap, F.greatest("_o.a", "_o.b")).otherwise(F.col("_o.a")).alias("a"), F.when(swap, F.least("_o.a", "_o.b")).otherwise(F.col("_o.b")).alias("b"))
    a, b, op = F.col("a"), F.col("b"), F.col("op")
    ans = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise((a / b).cast("long"))
    one = c == "addsub_d1"
    ask = F.when(op == "+", text(a, F.when(one, "와 ").otherwise("에 "), b, "를 더하면?")).when(op == "-", text(a, "에서 ", b, "를 빼면?"))
    ask = ask.when(op == "*", F.when(c == "mul_1x1", text(a, " 곱하기 ", b, "는?")).otherwise(text(a, "에 ", b, "를 곱하면?"))).otherwise(text(a, "을 ", b, "로 나누면?"))
    none = F.array().cast("array<string>")

    size = by_kind(lambda k: F.lit(int(k[-1]) if k[:3] in ("add", "sub") else 1))
    steps = F.when(one, none).when(op == "+", add_steps(a, b, size)).when(op == "-", sub_steps(a, b, size)).when(c == "mul_2x1", mul_steps(a, b, 1)).when(c.startswith("mul_2x2"), mul_steps(a, b, 2))
    steps = steps.when(op == "/", F.array(text(a, "÷", b, "=", ans), text("검산: ", b, "×", ans, "=", a))).otherwise(none)
    share = by_kind(lambda k: F.lit(1.0 if k[-2:] == "d4" else 0.35 if k[:3] in ("add", "sub") and k != "addsub_d1" else {"mul_2x1": 0.75, "mul_2x2_easy": 0.60, "mul_2x2_hard": 0.60}.get(k, 0.50 if k.startswith("div") else 0.0)))
    r = r.withColumns({"_ans": ans, "_ask": ask, "_worked": (share >= 1.0) | (d.chance("steps") < share), "_u": d.chance("mode"), "_style": d.below("style", 3)})
    ans, worked, u, style = F.col("_ans"), F.col("_worked"), F.col("_u"), F.col("_style")
    mode = F.when(worked, F.when(u < 0.45, "final").when(u < 0.65, "answer").otherwise("bare")).otherwise(F.when(u < 0.55, "bare").when(u < 0.85, "final").otherwise("answer"))
    tail = F.when(mode == "final", text("최종답: ", ans)).when(mode == "answer", text("정답: ", ans)).otherwise(ans.cast("string"))
    end = F.when(worked, LAST_STEPS).otherwise(d.choice("end", [LAST_PLAIN, LAST_FINAL]))
    expr = F.concat(a.cast("string"), op, b.cast("string"))
    prompt = F.when(style == 0, text(expr, "=\n", end)).when(style == 1, text("다음을 계산하라. ", expr, "\n", end)).otherwise(text(F.col("_ask"), "\n", end))
    out = F.when(worked, text(STEP_PREFIX, F.array_join(steps, " "), "\n", tail)).otherwise(tail)
    names = F.concat(c, F.lit("_"), F.element_at(F.array(*[F.lit(s) for s in ("symbolic", "calc", "word")]), (style + 1).cast("int")))
    return r.select(key, prompt.alias("input"), out.alias("output"), ans.cast("string").alias("final_answer"), "category", names.alias("prompt_style"), F.when(worked, "1").otherwise("0").alias("has_cot"))


# ------------------------------------------------------------------ word problems


def clock(d: Draw) -> Column:
    return let({"per": d.between("per", 1, 18), "days": d.between("days", 2, 30)}, _drift)


def _drift(per: Column, days: Column) -> Column:
    ans = text(per * days, "분")
    return item(text("시계가 하루에 ", per, "분 느려진다. 정확한 시간에 맞춘 뒤 ", days, "일이 지나면 몇 분 차이인가?"), text(per, "분씩 ", days, "일이면 ", per * days, "분입니다."), ans, "clock_drift")


def ratio_problem(d: Draw) -> Column:
    numbers = {"a": d.between("ra", 1, 9), "b": d.between("rb", 1, 9), "m": d.between("unit", 5, 80)}
    return let({**numbers, "left": d.choice("left", ["설탕", "연필", "빨간 구슬", "남학생"]), "right": d.choice("right", ["밀가루", "공책", "파란 구슬", "여학생"])}, _shared)


def _shared(a: Column, b: Column, m: Column, left: Column, right: Column) -> Column:
    return item(text(left, "과 ", right, "의 비율이 ", a, ":", b, "이다. ", right, "이 ", b * m, "개라면 ", left, "은 몇 개인가?"),
                text(right, " ", b * m, "개는 비율 ", b, "에 해당하므로 한 단위는 ", m, "이고, ", left, "은 ", a, "단위라서 ", a * m, "개이다."), (a * m).cast("string"), "ratio")


def linear(d: Draw) -> Column:
    return let({"x": d.between("x", 2, 60), "off": d.between("off", 2, 12), "mul": d.between("lmul", 2, 9)}, _solved)


def _solved(x: Column, off: Column, mul: Column) -> Column:
    goal = (x + off) * mul
    return item(text("어떤 수에 ", off, "을 더하고 ", mul, "를 곱하면 ", goal, "가 된다. 그 수를 구하라."), text(goal, "÷", mul, "=", x + off, ", ", x + off, "-", off, "=", x), x.cast("string"), "linear_add_then_mul")


def latex_fraction(d: Draw) -> Column:
    return let({"n": d.between("num", 1, 20), "m": d.between("den", 2, 20)}, _fraction)


def _fraction(n: Column, m: Column) -> Column:
    return item(text("분수 ", n, "/", m, "를 LaTeX 수식으로 써라."), F.lit("분자와 분모를 차례로 쓴다."), text("\\frac{", n, "}{", m, "}"), "latex_fraction")


def latex_equation(d: Draw) -> Column:
    numbers = {"up": d.between("upper", 3, 12), "a": d.between("ca", 2, 9), "b": d.between("cb", 1, 12), "c": d.between("cc", 20, 120)}
    return let({**numbers, "total": d.below("form", 2) == 0}, _equation)


def _equation(up: Column, a: Column, b: Column, c: Column, total: Column) -> Column:
    return item(F.when(total, text("1부터 ", up, "까지의 합을 나타내는 시그마 수식을 LaTeX로 써라.")).otherwise(text("일차방정식 ", a, "x + ", b, " = ", c, "를 LaTeX로 써라.")),
                F.lit("식을 그대로 옮긴다."), F.when(total, text("\\sum_{i=1}^{", up, "} i")).otherwise(text(a, "x+", b, "=", c)), "latex_equation")


GENERATORS = {
    "compare_smallest": compare_smallest, "probability": probability, "sequence": sequence_rule, "syllogism": syllogism, "sentence_relation_yesno": relation,
    "clock_drift": clock, "ratio": ratio_problem, "linear_add_then_mul": linear, "latex_fraction": latex_fraction, "latex_equation": latex_equation,
}

# Share of each generated category.
MIX_WEIGHTS = (
    ("ratio", 0.25), ("probability", 0.15), ("compare_smallest", 0.15), ("linear_add_then_mul", 0.15), ("clock_drift", 0.08), ("sequence", 0.10),
    ("syllogism", 0.06), ("latex_fraction", 0.03), ("latex_equation", 0.03),
)


def generate(df: DataFrame, key: str, name: str, seed) -> DataFrame:
    """Rows of one generator for the ids of ``df``."""
    return df.select(key, GENERATORS[name](Draw(seed, key)).alias("_i")).select(key, "_i.*")


def generator_mix(df: DataFrame, key: str, seed, weights: Sequence[tuple[str, float]] = MIX_WEIGHTS) -> DataFrame:
    """Weighted choice of a generator per row; only the chosen one is evaluated."""
    d = Draw(seed, key)
    df = df.select(key, d.chance("kind").alias("_u"))
    u, acc, out = F.col("_u"), 0.0, None
    for name, w in weights[:-1]:
        acc += w
        out = F.when(u <= round(acc, 6), GENERATORS[name](d)) if out is None else out.when(u <= round(acc, 6), GENERATORS[name](d))
    return df.select(key, out.otherwise(GENERATORS[weights[-1][0]](d)).alias("_i")).select(key, "_i.*")
