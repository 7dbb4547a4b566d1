"""Positioned text: printed contents, box joins, figure labels, the cascade and its assembly, on hand-worked pages."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import boxes, figure_labels, figure_matching, page_index, printed_toc, symptoms, tables


def test_boxes_meet_as_by_force(spark):
    rng = random.Random(1)

    def some(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-300, 600), rng.uniform(-100, 900)
            out.append((rng.randint(1, 2), i, x, y, x + rng.choice([0, 5, 40, 700]), y + rng.choice([0, 9, 60, 400])))
        return out

    a, b = [*some(60), (1, 99, 0.0, 0.0, 128.0, 128.0), (1, 100, None, 0.0, 1.0, 1.0)], [*some(60), (1, 99, 128.0, 128.0, 128.0, 128.0), (1, 98, 9.0, 0.0, 3.0, 1.0)]
    schema = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    found = boxes.meeting(spark.createDataFrame(a, schema.format("i")), spark.createDataFrame(b, schema.format("j")), ["page"])
    wanted = {(p, i, j) for p, i, *u in a for q, j, *v in b if p == q and None not in u and v[0] <= v[2] and u[0] <= v[2] and v[0] <= u[2] and u[1] <= v[3] and v[1] <= u[3]}
    rows = [(r.page, r.i, r.j) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_two_column_contents(spark):
    """Titles at two indents, numbers in a column of slightly different places, one number elsewhere, one large heading."""
    spans = [("CONTENTS", 40, 10, 20.0)]
    for i in range(6):
        spans += [(f"title {i}", 40 if i % 2 else 70, 50 + 20 * i, 9.0), (f" {i + 3} ", 300 + i % 3, 52 + 20 * i, 9.0)]
    spans += [("99", 150, 52, 9.0), ("no number near", 40, 300, 9.0), ("lone level", 200, 90, 9.0)]
    rows = spark.createDataFrame([(1, 1, i, float(x), float(y), s, t) for i, (t, x, y, s) in enumerate(spans)] + [(1, 2, 0, 1.0, 1.0, 9.0, "nothing"), (1, None, 0, 1.0, 1.0, 9.0, "5")], "doc int, page int, span int, x double, y double, size double, text string")
    found = printed_toc.column_entries(rows, ["doc"]).orderBy("nth").collect()
    assert [(r.title, r.level, r.number) for r in found] == [("title 0", 2, 3), ("title 2", 2, 5), ("title 4", 2, 7), ("title 1", 1, 4), ("title 3", 1, 6), ("title 5", 1, 8)] or [r.number for r in found] == sorted(r.number for r in found)
    assert {r.title: r.number for r in found} == {f"title {i}": i + 3 for i in range(6)} and {r.title: r.level for r in found} == {f"title {i}": 1 if i % 2 else 2 for i in range(6)}


def test_block_contents(spark):
    lines = [("index", 0, 0), ("Chapter\t", 1, 0), ("7", 1, 1), ("a", 2, 0), ("8", 2, 1), ("12", 2, 2), ("b", 2, 3), (" ", 2, 4), ("9", 2, 5), ("c", 2, 6)]
    rows = spark.createDataFrame([(1, 1, b, n, 40.0 + 300 * (b == 1), 10.0 * b, t) for t, b, n in lines] + [(1, 2, 0, 0, 0.0, 0.0, "x"), (1, 2, 0, 1, 0.0, 0.0, "1")], "doc int, page int, block int, line int, x double, y double, text string")
    found = printed_toc.block_entries(rows, ["doc"], F.contains("text", F.lit("index"))).orderBy("nth").collect()
    assert [(r.level, r.title, r.number) for r in found] == [(2, "a", 8), (2, "b", 9), (1, "Chapter", 7)]


LINE = "doc int, page int, line long, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string"


def page(spark, lines, figures, width=600.0):
    rows = [(1, 1, i, float(x0), float(y0), float(x1), float(y1), s, s > 10, t) for i, (t, x0, y0, x1, y1, s) in enumerate(lines)]
    boxed = spark.createDataFrame([(1, 1, i, *map(float, f)) for i, f in enumerate(figures)], "doc int, page int, figure long, x0 double, y0 double, x1 double, y1 double")
    return spark.createDataFrame(rows, LINE), boxed, spark.createDataFrame([(1, 1, width)], "doc int, page int, width double")


def labels_of(spark, lines, figures):
    found = figure_labels.label_candidates(*page(spark, lines, figures), ["doc"]).orderBy("k", "ord").collect()
    return [(r.k, r.kind, r.label) for r in found]


def test_labels_above_stop_at_gaps_headings_and_figures(spark):
    lines = [("far away", 40, 20, 200, 32, 9.0), ("Heading here", 40, 100, 200, 112, 11.0), ("first step text", 40, 116, 300, 128, 9.0), ("second step text", 40, 132, 300, 144, 9.0), ("third step text", 40, 148, 300, 160, 9.0)]
    figure = (60, 165, 180, 260)
    run = "Heading here first step text second step text third step text"
    assert labels_of(spark, lines, [figure]) == [(0, "near", "second step text third step text"), (0, "above", run), (0, "head_far", "Heading here")]
    # a figure between the second and the third line ends the run there
    between = [("first step text", 40, 80, 300, 92, 9.0), ("second step text", 40, 122, 300, 134, 9.0)]
    assert labels_of(spark, between, [(60, 96, 180, 119), (60, 140, 180, 200)])[-2:] == [(1, "near", "second step text"), (1, "above", "second step text")]


def test_labels_beside_below_and_in_columns(spark):
    row = [("left of it", 40, 110, 190, 122, 9.0), ("right of it", 340, 130, 500, 142, 9.0), ("under it, and long enough for a text", 200, 305, 420, 317, 9.0)]
    assert labels_of(spark, row, [(200, 100, 330, 300)]) == [(0, "beside", "left of it right of it")]
    legend = [(f"part {i}", 200, 210 + 14 * i, 260, 222 + 14 * i, 9.0) for i in range(4)]
    assert labels_of(spark, legend, [(200, 100, 330, 205)]) == [(0, "below", "part 0 part 1 part 2 part 3")]
    two = [(f"left {i} line", 40, 60 + 40 * i, 200, 72 + 40 * i, 9.0) for i in range(8)] + [(f"right {i} line", 340, 60 + 40 * i, 500, 72 + 40 * i, 9.0) for i in range(8)]
    two += [("Owner", 340, 200, 420, 212, 11.0), ("Other", 340, 380, 420, 392, 11.0)]
    found = labels_of(spark, two, [(340, 390, 500, 450), (40, 400, 200, 450)])
    assert [x for x in found if x[1] == "head"] == [(1, "head", "Other")] and not any(x[1] == "head_far" for x in found)


ANSWER = ["1. 필터를 분리해서 물로 씻어 주세요 그리고 말려요", "2. 문을 닫고 전원을 켜세요 지금 바로", "", "손잡이 받침대 조절다리", "배수호스 급수호스 필터", "", "아주 다른 이야기를 하는 줄입니다"]


def cascade(spark, labels, similar=(), elsewhere=(), pixels=(), external=(), near=(), lines=ANSWER):
    table = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    label = "a int, page long, k int, ord int, kind string, label string"
    found = figure_matching.figures_for_answers(
        table([(1, i, t) for i, t in enumerate(lines)], "a int, line long, text string"), table([(1, *x) for x in labels], label), table([(1, *x) for x in elsewhere], label),
        table([(1, *x) for x in similar], "a int, line long, page long, k int, ord int, sim double"), table([(1, *x) for x in pixels], "a int, page long, k int, pixels array<double>"),
        table([(1, *x) for x in external], "a int, nth long, url string, alt string, role string"), table([(1, *x) for x in near], "a int, nth long, line long, sim double"), ["a"],
    )
    return sorted((r.line, r.page or 0, -1 if r.k is None else r.k, r.kind, r.url or "") for r in found.collect())


def test_cascade_of_matchers(spark):
    labels = [
        (1, 0, 2, "near", "필터를 분리해서 물로 씻어 주세요"),  # a line's own words
        (1, 1, 0, "head", "짧은말"), (1, 1, 2, "near", "문을 닫고 전원을 켜세요"),  # the second label passes
        (1, 2, 5, "below", "손잡이 받침대 조절다리 배수호스 급수호스 필터"),  # a legend: a block of lines
        (1, 3, 2, "near", "이 그림은 손잡이를 위로 미는 모습"),  # by meaning
        (1, 4, 2, "near", "필터를 끼우는 모습을 보여 준다"),  # nearest line says the opposite
        (1, 5, 4, "head_far", "조절다리"),  # short of four letters: too short to look for
        (1, 6, 4, "head_far", "배수호스급"),  # two grams, whole in a line
    ]
    similar = [(6, 1, 3, 2, 0.9), (1, 1, 3, 2, 0.7), (0, 1, 4, 2, 0.95), (6, 1, 4, 2, 0.5)]
    assert cascade(spark, labels, similar) == [(0, 1, 0, "near", ""), (1, 1, 1, "near", ""), (4, 1, 2, "below-block", ""), (4, 1, 6, "head_far/short", ""), (6, 1, 3, "semantic", "")]


def test_figures_of_other_pages_are_one_of_each_picture(spark):
    text = "아주 다른 이야기를 하는 줄입니다 그리고"
    elsewhere = [(9, 0, 2, "near", text), (9, 1, 2, "near", text + " 또한"), (9, 2, 2, "near", "이야기를 하는 줄입니다 그런데 또 있다")]
    similar = [(6, 9, 0, 2, 0.97), (6, 9, 1, 2, 0.96), (6, 9, 2, 2, 0.95)]
    same = [(9, 0, [10.0, 10.0]), (9, 1, [12.0, 13.0]), (9, 2, [200.0, 0.0])]
    assert cascade(spark, [], similar, elsewhere, same) == [(6, 9, 0, "wide-sem", ""), (6, 9, 2, "wide-sem", "")]
    unlike = [(9, 0, [10.0, 10.0]), (9, 1, [90.0, 13.0]), (9, 2, [200.0, 0.0])]
    assert cascade(spark, [], similar, elsewhere, unlike) == [(6, 9, 2, "wide-sem", "")]
    # a line that has a figure already asks for none
    taken = [(1, 0, 2, "near", "아주 다른 이야기를 하는 줄입니다")]
    assert cascade(spark, taken, similar, elsewhere, same) == [(6, 1, 0, "near", "")]


def test_caps_and_external_pictures(spark):
    labels = [(1, k, 2, "near", "필터를 분리해서 물로 씻어 주세요") for k in range(8)] + [(1, 20 + k, 2, "near", "문을 닫고 전원을 켜세요") for k in range(3)]
    external = [(0, "u0", "표시부", "thumb"), (1, "u1", "표시부", "thumb"), (2, "u2", "문을 닫고 전원을 켜세요 지금", "body"), (3, "u2", "again", "thumb"), (4, "u4", "이야기를 말하는 사람의 모습", "body"), (5, "u5", None, "body")]
    found = cascade(spark, labels, external=external, near=[(4, 6, 0.6), (4, 3, 0.5)])
    assert [x for x in found if x[0] == 0] == [(0, 1, k, "near", "") for k in range(6)]  # six a line: the thumbnail has no room
    assert [x for x in found if x[0] == 1] == [(1, 0, -1, "ext-body", "u2"), *((1, 1, 20 + k, "near", "") for k in range(3))]
    assert [x for x in found if x[0] == 6] == [(6, 0, -1, "ext-body-sem", "u4")] and len(found) == 11


def test_greedy_caps_by_force(spark):
    rng = random.Random(4)
    hits = [(a, rng.randint(0, 6), 1, k, "near", "", "") for a in range(6) for k in range(rng.randint(0, 50))]
    external = [(a, n, rng.randint(0, 6), f"u{n}", "c", "ext-body") for a in range(6) for n in range(rng.randint(0, 30))]
    found = figure_matching.assembled(spark.createDataFrame(hits, "a int, line long, page long, k int, kind string, caption string, label string"), spark.createDataFrame(external, "a int, nth long, line long, url string, caption string, kind string"), ["a"], 4, 12)
    wanted = []
    for a in range(6):
        used, total = {}, 0
        for line, key in [(h[1], ("", h[3])) for h in sorted(h for h in hits if h[0] == a)] + [(e[2], (e[3], -1)) for e in sorted(e for e in external if e[0] == a)]:
            if total < 12 and used.get(line, 0) < 4:
                used[line], total = used.get(line, 0) + 1, total + 1
                wanted.append((a, line, *key))
    assert sorted((r.a, r.line, r.url or "", -1 if r.k is None else r.k) for r in found.collect()) == sorted(wanted)


def test_pages_hold_passages_as_by_force(spark):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abc de") for _ in range(n))
    pages = {(d, p): text(rng.choice([0, 17, 18, 200, 900])) for d in range(3) for p in range(6)}
    pages[0, 4] = pages[0, 1]
    probes = []
    for d in range(3):
        for i in range(60):
            whole = pages[d, rng.randrange(6)]
            at = rng.randint(0, max(0, len(whole) - 5))
            probes.append((d, i, whole[at : at + rng.choice([3, 17, 18, 19, 60, 120])] if rng.random() < 0.8 else text(20)))
    rows = spark.createDataFrame(probes, "d int, i int, probe string")
    found = page_index.holding_pages(rows, spark.createDataFrame([(d, p, t) for (d, p), t in pages.items()], "d int, page int, text string"), ["d"], ["i"])
    wanted = {(d, i, p) for d, i, probe in probes if probe for (e, p), t in pages.items() if d == e and probe in t}
    got = [(r.d, r.i, r.page) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_anchors_follow_the_text_alone():
    rng = random.Random(3)
    inner = "".join(rng.choice("abcdefgh") for _ in range(page_index.WINDOW))
    own = page_index.anchors(inner)
    assert len(own[0]) == 1
    for _ in range(50):
        before = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40)))
        places, hashes = page_index.anchors(before + inner + "zz")
        assert (len(before) + own[0][0], own[1][0]) in set(zip(places.tolist(), hashes.tolist()))
    assert len(page_index.anchors("short")[0]) == 0 and len(page_index.anchors("a" * 5000)[0]) < 5000


def test_symptoms_across_sections(spark):
    rows = [
        (1, 0, "안내", ["제품"], "그대로 둡니다", 1),
        (1, 1, "문제 해결", ["제품"], "증상\n안에서 냄새가 나요.\n문이 열려\n있나요?\n• 문을 닫아 주세요.", 2),
        (1, 2, "소음", ["고장 신고 전"], "12\n청소를 했나요?\n안에서 냄새가 나요.\n오래 됐나요?", 3),
        (1, 3, "끝", [], "안에서 냄새가 나요.\n맞나요?", 4),
        (1, 4, "트러블", [], "아무 증상도 없습니다 이것은 아주 길어서 마흔다섯 글자를 훌쩍 넘어가는 한 줄의 문장일 뿐이라고 합니다.\n왜 그런가요?", 5),
    ]
    df = spark.createDataFrame(rows, "doc int, seq int, heading string, ancestors array<string>, text string, page int")
    found = [(r.seq, r.part, r.heading, r.text, r.page) for r in symptoms.resplit_by_symptom(df, ["doc"]).orderBy("seq", "part").collect()]
    assert found[1:3] == [
        (1, 1, "안에서 냄새가 나요. (1)", "안에서 냄새가 나요. 문이 열려 있나요? • 문을 닫아 주세요. 청소를 했나요?", 2),
        (1, 2, "안에서 냄새가 나요. (2)", "안에서 냄새가 나요. 오래 됐나요?", 2),
    ]
    assert [(f[0], f[2]) for f in found] == [(0, "안내"), (1, found[1][2]), (1, found[2][2]), (3, "끝"), (4, "트러블")]


def test_symptom_tables_go_on_over_pages(spark):
    rows = [(1, 1, 50, 1, "물이  새요", "호스 확인"), (1, 1, 50, 2, "", "• 밸브\n확인"), (1, 1, 50, 3, "소리", " "), (1, 2, 10, 1, "물이 새요", "또 확인"), (1, 2, 80, 1, "소리", "수평")]
    heads = [(1, 1, 20, 2, "문제 해결하기"), (1, 1, 30, 3, "누수"), (1, 2, 60, 2, "소음")]
    found = symptoms.symptom_tables(spark.createDataFrame(rows, "doc int, page int, y int, row long, symptom string, cause string"), spark.createDataFrame(heads, "doc int, page int, y int, level int, title string"), ["doc"])
    assert [(r.category, r.symptom, r.body) for r in found.orderBy("chunk").collect()] == [("누수", "물이 새요", "증상: 물이 새요\n호스 확인\n• 밸브 확인\n또 확인"), ("소음", "소리", "증상: 소리\n수평")]


def test_forms_of_pages(spark):
    cells = [(1, 1, 0, 0, ["카테고리", "증상", "원인 및 해결책"]), (1, 1, 0, 1, ["운전", "안 켜져요", "전원 확인"]), (1, 1, 0, 2, ["", "", "차단기 확인"]), (1, 1, 0, 3, ["소음", "시끄러워요", "수평 확인"]), (1, 4, 0, 0, ["품목", "값"]), (1, 4, 0, 1, ["a", "b"])]
    lines = [
        (1, 2, 0, 20.0, "큰 제목"), (1, 2, 1, 11.0, "증상 하나"), (1, 2, 2, 10.0, "•"), (1, 2, 3, 10.0, "원인을 살펴보고 필요한 조치를 합니다 그리고 다시 켭니다"),
        (1, 3, 0, 10.0, "물이 안 나요!"), (1, 3, 1, 10.0, "• 밸브를 열고 필터를 청소한 뒤에 다시 확인해 보세요 그래도"), (1, 3, 2, 10.0, "확인하세요."), (1, 3, 3, 10.0, "• 짧음"), (1, 1, 0, 10.0, "표 위의 글은 읽지 않습니다 아무리 길어도 그렇습니다 정말로요"),
    ]
    found = symptoms.sections_by_form(spark.createDataFrame(cells, "doc int, page int, table int, row long, cells array<string>"), spark.createDataFrame(lines, "doc int, page int, line long, size double, text string"), spark.createDataFrame([], "doc int, page int, title string"), [], ["doc"])
    rows = [(r.form, r.label, r.symptom, r.body) for r in found.orderBy("form", "chunk").collect()]
    assert rows[:2] == [("table", "운전", "안 켜져요", "증상: 안 켜져요\n전원 확인\n차단기 확인"), ("table", "소음", "시끄러워요", "증상: 시끄러워요\n수평 확인")]
    assert [r[:3] for r in rows[2:]] == [("text", "큰 제목 > 증상 하나", "증상 하나"), ("text", "큰 제목 > 물이 안 나요!", "물이 안 나요!")] and rows[2][3].startswith("• 원인을")


def test_places_and_containing(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i) for i in range(300)]
    found = tables.placed(spark.createDataFrame(rows, "k string, i int").repartition(5), "k", ["i"]).collect()
    seen = {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        seen.setdefault(k, []).append(i)
    assert {(r.k, r.i, r.place) for r in found} == {(k, i, n) for k, v in seen.items() for n, i in enumerate(v)}
    texts, parts = ["abcabc", "", "xabx", None], ["ab", "abcabc", "zz", "", "c"]
    pairs = tables.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    assert {(r.t, r.p) for r in pairs.collect()} == {("abcabc", "ab"), ("abcabc", "abcabc"), ("abcabc", "c"), ("xabx", "ab")}


def test_a_page_is_one_row(spark):
    """Lines and figures meet by page: no grid cells, no row for a pair, so texts are moved once. Odd boxes do no harm."""
    lines = spark.createDataFrame([(1, 1, 0, 60.0, 80.0, 300.0, 92.0, 9.0, False, "turn the knob"), (1, 1, 1, 60.0, 95.0, 300.0, 107.0, 9.0, None, "slowly"), (1, 1, 2, None, 99.0, 300.0, 107.0, 9.0, False, "no edge"), (1, 2, 3, 60.0, 80.0, 300.0, 92.0, None, True, "alone"), (1, 1, 4, 60.0, 80.0, 300.0, 92.0, 9.0, False, None)], "doc int, page int, line long, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, text string")
    figures = spark.createDataFrame([(1, 1, 7, 60.0, 110.0, 200.0, 200.0), (1, 1, 8, None, 90.0, 200.0, 200.0), (1, 3, 9, 60.0, 110.0, 200.0, 200.0), (2, 1, 9, 60.0, 110.0, 200.0, 200.0)], "doc int, page int, figure long, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1, 600.0), (1, 2, 600.0), (1, 3, None)], "doc int, page int, width double")
    found = figure_labels.label_candidates(lines, figures, pages, ["doc"])
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 7, 1, 2, "near", "turn the knob slowly"), (1, 1, 7, 1, 3, "above", "turn the knob slowly")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Window" not in plan and "Generate" not in plan
    assert figure_labels._rounded(2.675, 2) == 2.68 and figure_labels._rounded(10.08, 6) == 10.08 and figure_labels._rounded(float("inf"), 1) == float("inf")


def test_texts_are_cleaned_once(spark):
    rows = spark.createDataFrame([(0, "- turn the knob slowly •"), (1, "too short"), (2, None), (3, " " * 20)], "i int, t string")
    found = figure_matching.speaking(rows, "t").select("i", "clean")
    assert [tuple(r) for r in found.collect()] == [(0, "turn the knob slowly")]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("regexp_replace(") == 4
