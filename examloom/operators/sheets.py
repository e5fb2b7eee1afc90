"""Answer sheets and answer keys given as coordinates and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.scans import running
from examloom.functions.text import let


def mark_decision(bubbles: DataFrame, options: int = 5) -> DataFrame:
    """Mark of every question from its bubbles: a letter, MULTI, or null for blank.

    ``bubbles(sheet_id, q, opt, fill_ratio, mean_val, is_filled)`` with ``opt``
    from 0 to ``options`` - 1 as the template says; another one is an error.  Plain conditional maxima per option bring the bubbles together, so
    the aggregation is combined before the shuffle.
    """
    # Fixed values below: the thresholds of fill and brightness.
    n = options
    known = F.when(F.col("opt").between(0, n - 1), F.col("opt")).otherwise(
        F.raise_error(F.lit("a bubble lies beyond the options of the template")).cast("int"))
    bubbles = bubbles.withColumn("opt", known)
    aggs = []
    for i in range(n):
        here = F.col("opt") == i
        aggs += [
            F.max(F.when(here, F.col("fill_ratio"))).alias(f"_f{i}"),
            F.max(F.when(here, F.col("mean_val"))).alias(f"_m{i}"),
            F.max(F.when(here, F.col("is_filled"))).alias(f"_x{i}"),
        ]
    wide = bubbles.groupBy("sheet_id", "q").agg(*aggs)
    cells = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"_f{i}").alias("f"), F.col(f"_m{i}").alias("m"),
                     F.coalesce(F.col(f"_x{i}"), F.lit(False)).alias("x"))
            for i in range(n)
        ]),
        lambda c: c["f"].isNotNull(),
    )
    rows = wide.select("sheet_id", "q", cells.alias("_c"))
    fills, means = F.transform("_c", lambda c: c["f"]), F.transform("_c", lambda c: c["m"])
    rows = rows.withColumn("_f", fills).withColumn("_m", means)
    ranked = F.sort_array("_f", asc=False)
    rows = (
        rows.withColumn("_r0", F.element_at(ranked, 1))
        .withColumn("_r1", F.try_element_at(ranked, F.lit(2)))
        .withColumn("_lo", F.array_min("_m"))
        .withColumn("_hi", F.array_max("_m"))
    )

    def opt_at(position) -> Column:
        return F.element_at("_c", position.cast("int"))["i"]

    def first_with(test) -> Column:
        return F.try_element_at(F.filter("_c", test), F.lit(1))["i"]

    # The last option that beats every option before it and counts as filled.
    records = F.filter(
        F.col("_c"),
        lambda c, i: c["x"] & (c["f"] > F.coalesce(F.array_max(F.slice("_f", F.lit(1), i)), F.lit(0.0)))
        & (c["f"] > 0),
    )
    leading = F.try_element_at(records, F.lit(-1))["i"]
    filled = F.filter("_c", lambda c: c["x"])
    darkest = F.array_min(F.transform(filled, lambda c: F.struct(c["m"].alias("m"), c["i"].alias("i"))))["i"]
    chosen = (
        F.when(leading.isNull() & (F.size(filled) > 0), darkest)
        .when(F.size(filled) == 1, F.element_at(filled, 1)["i"])
        .otherwise(leading)
    )
    rows = rows.withColumn("_s", chosen)

    top = first_with(lambda c: c["f"] == F.col("_r0"))
    clear = F.coalesce(F.col("_r0") > F.col("_r1") * 1.3, F.lit(False))

    bright = F.filter("_c", lambda c: c["m"] == F.col("_hi"))
    bright_ok = F.element_at(bright, 1)["f"] > 0.1
    valid = F.filter("_c", lambda c: (c["m"] > 100) | (c["f"] > 0.3))
    best_valid = F.array_max(F.transform(valid, lambda c: F.struct(c["f"].alias("f"), (-c["i"]).alias("n"))))["n"]
    dark_pick = F.when(
        F.col("_hi") - F.col("_lo") > 50,
        F.when(bright_ok, F.element_at(bright, 1)["i"]).otherwise(F.coalesce(-best_valid, F.col("_s"))),
    ).otherwise(F.col("_s"))

    lone = F.when(F.col("_s").isNull() & (F.col("_r0") > 0.25) & clear, top).otherwise(F.col("_s"))
    limit = F.when(F.col("_r0") > 0.5, F.col("_r0") * 0.6).otherwise(0.35)
    several = F.size(F.filter("_f", lambda f: f > limit)) > 1
    top_mean = F.element_at(F.filter("_c", lambda c: c["f"] == F.col("_r0")), 1)["m"]
    wins = (top_mean == F.col("_lo")) | clear | ((F.col("_r0") > 0.5) & (F.col("_r1") < 0.4))
    lowest = first_with(lambda c: c["m"] == F.col("_lo"))
    normal = (
        F.when(~several, lone)
        .when(wins, top)
        .when(F.col("_hi") - F.col("_lo") > 30, lowest)
        .otherwise(-1)
    )
    dark = F.size(F.filter("_m", lambda m: m < 50)) >= 3
    mark = F.when(dark, dark_pick).otherwise(normal)
    return rows.withColumn("_mark", mark).select(
        "sheet_id", "q",
        F.when(F.col("_mark") == -1, "MULTI").otherwise(F.char(F.col("_mark") + 65)).alias("student"),
        F.transform("_f", lambda f: F.bround(f, 3)).alias("fill_ratios"),
    )


def row_cluster(rects: DataFrame, tolerance: float = 15) -> DataFrame:
    """Row of every rectangle of a sheet: a row ends when y leaves its first y by more than ``tolerance``.

    ``rects(sheet_id, cx, cy, …)``.  Only the distinct y of a sheet, which are
    no more than the lines of its image, come together to find where rows begin; rectangles then look their y
    up, so that a sheet of many is spread by y.  Without a y or a sheet the row is 0.
    """
    ys = rects.groupBy("sheet_id").agg(F.array_sort(F.collect_set("cy")).alias("_ys"))
    start = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("row"))

    def step(now, y):
        begins = now["first"].isNull() | (y.cast("double") - now["first"] > tolerance)
        return F.struct(F.when(begins, y.cast("double")).otherwise(now["first"]).alias("first"),
                        (now["row"] + begins.cast("int")).alias("row"))

    rows = F.transform(running(F.col("_ys"), start, step, "struct<first:double,row:int>"), lambda s: s["row"])
    placed = ys.select("sheet_id", F.explode(F.arrays_zip("_ys", rows.alias("row_no"))).alias("_y"))
    placed = placed.select("sheet_id", F.col("_y._ys").alias("cy"), F.col("_y.row_no").alias("_row"))
    return rects.join(placed, ["sheet_id", "cy"], "left").select(*rects.columns, F.coalesce("_row", F.lit(0)).alias("row_no"))


def gap_group(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """Bubbles of sheet rows to questions and options.

    ``rows(sheet_id, template, row_no, cx, cy)``, ``templates(template,
    questions, options, questions_per_row, layout)``.  Bubbles closer than 10
    to the last kept one go.  Rows of 0.8–1.3 times the expected size are
    split at gaps above 1.3 × median when the largest exceeds 1.4 × median, else in equal
    parts; smaller rows count only below the last full row.
    """
    per_row = rows.groupBy("sheet_id", "template", "row_no").agg(
        F.array_sort(F.collect_set(F.col("cx").cast("double"))).alias("_xs"),
        F.min_by("cy", "cx").alias("_y"),
    )
    kept = F.array_distinct(running(
        F.col("_xs"), F.lit(None).cast("double"), lambda last, x: F.when(last.isNull() | (x - last > 10), x).otherwise(last), "double"))
    spec = templates.select("template", "questions", "options", "questions_per_row", "layout")
    sized = per_row.select("sheet_id", "template", "row_no", "_y", kept.alias("_xs")).join(spec, "template")
    n, opts = F.size("_xs"), F.col("options")
    expected = F.col("questions_per_row") * opts
    kind = F.when(n.between(expected * 0.8, expected * 1.3), "full").when(n.between(opts, expected * 0.8), "part")
    sized = sized.withColumn("_kind", kind).filter(F.col("_kind").isNotNull())

    sheet = Window.partitionBy("sheet_id", "template")
    last_full = F.max(F.when(F.col("_kind") == "full", F.col("_y"))).over(sheet)
    usable = sized.withColumn("_last", last_full).filter(
        (F.col("_kind") == "full") | F.col("_last").isNull() | (F.col("_y") > F.col("_last"))
    )
    gaps = F.zip_with(F.slice("_xs", F.lit(2), n), F.slice("_xs", F.lit(1), n - 1), lambda b, a: b - a)
    ordered = F.array_sort(gaps)
    m = F.size(gaps)
    median = (
        F.element_at(ordered, F.floor((m + 1) / 2).cast("int")) + F.element_at(ordered, F.floor((m + 2) / 2).cast("int"))
    ) / 2
    usable = usable.withColumn("_median", F.when(m > 0, median)).withColumn("_widest", F.array_max(gaps))

    # A break is a wide gap after enough bubbles: the walk counts the bubbles of the open group.
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("last"))

    def step(now, x):
        wide = F.coalesce((x - now["last"] > F.col("_median") * 1.3) & (now["n"] >= opts - 1), F.lit(False))
        return F.struct(F.when(wide, 1).otherwise(now["n"] + 1).alias("n"), x.alias("last"))

    begins = F.filter(
        F.transform(running(F.col("_xs"), start, step, "struct<n:int,last:double>"), lambda s, i: F.when(s["n"] == 1, i + 1)),
        lambda i: i.isNotNull())

    def from_breaks(at):
        sizes = F.transform(at, lambda a, j: F.struct(a.alias("a"), (F.coalesce(F.get(at, j + 1), n + 1) - a).alias("n")))
        return F.transform(F.filter(sizes, lambda g: g["n"] >= opts - 1), lambda g: F.slice("_xs", g["a"], F.least(g["n"], opts)))

    by_gap = let(begins, from_breaks)
    chunks = F.filter(
        F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / opts).cast("int")),
            lambda i: F.slice("_xs", i * opts + 1, opts),
        ),
        lambda c: F.size(c) == opts,
    )
    groups = F.when((F.col("_kind") == "full") & (F.col("_widest") > F.col("_median") * 1.4), by_gap).otherwise(chunks)
    grouped = usable.withColumn("_groups", groups)

    # A sheet has few rows of bubbles; full rows come first, then the others, by y.
    order = Window.partitionBy("sheet_id", "template").orderBy("_kind", "_y", "row_no")
    # A row without a whole question has no number of its own.
    placed = grouped.withColumn("_r", F.count_if(F.size("_groups") > 0).over(order)).withColumn(
        "_before",
        F.coalesce(F.sum(F.size("_groups")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    column = F.col("layout") == "column"
    questions = placed.select(
        "sheet_id", "template", "row_no", "questions", "questions_per_row", "_r", "_before", "layout",
        F.posexplode("_groups").alias("_g", "_bubbles"),
    )
    number = F.when(column, (F.col("_r") - 1) * F.col("questions_per_row") + F.col("_g") + 1).otherwise(
        F.col("_before") + F.col("_g") + 1
    )
    numbered = questions.withColumn("q", number.cast("int")).filter(
        (F.col("q") <= F.col("questions")) & (~column | (F.col("_g") < F.col("questions_per_row")))
    )
    return numbered.select(
        "sheet_id", "template", "row_no", "q", F.posexplode("_bubbles").alias("opt", "cx")
    )


def nearest_right_match(
    spans: DataFrame, dy: float = 8, dx: float = 50, slack: float = 3, max_number: int | None = None, min_columns: int = 6
) -> DataFrame:
    """Answer letter next to each question number of a page, per column.

    ``spans(doc_id, seq, text, x, y)``.  An answer is to the right of its
    number, less than ``dx`` away, in the same line within ``dy``; a clearly
    closer line wins, else the closer x.  Columns are told apart by the places
    of the number 1.  Numbers above ``max_number`` are left out if the template gives one.  Numbers meet only the answers in the cells of a
    2 ``dx`` × 4 ``dy`` grid that their surroundings touch.  Both joins are hinted: spans that are exploded from a small table look small to
    the planner, and would be broadcast.
    """
    text = F.trim("text")
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    asked_for = F.col("q") >= 1 if max_number is None else F.col("q").between(1, max_number)
    letter = F.when(text.rlike("^[A-E]$") | (text.rlike("^[A-E]") & text.contains(",")), F.substring(text, 1, 1))
    wide, high = 2 * dx, 4 * dy
    cell = lambda c, step: F.floor(c / step).cast("bigint")
    # The same text at the same place counts once.
    numbers = spans.select("doc_id", "seq", "x", "y", number.alias("q")).filter(asked_for).groupBy("doc_id", "q", "x", "y").agg(F.min("seq").alias("seq"))
    answers = spans.select("doc_id", "seq", "x", "y", letter.alias("letter")).filter(
        F.col("letter").isNotNull()
    ).groupBy("doc_id", "letter", "x", "y").agg(F.min("seq").alias("a_seq")).select(
        "doc_id", "a_seq", F.col("x").alias("ax"), F.col("y").alias("ay"), "letter",
        cell(F.col("x"), wide).alias("_gx"), cell(F.col("y"), high).alias("_gy"),
    )
    x, y = F.col("x"), F.col("y")
    asked = numbers.withColumn("_gx", F.explode(F.sequence(cell(x, wide), cell(x + dx, wide)))).withColumn(
        "_gy", F.explode(F.sequence(cell(y - dy, high), cell(y + dy, high))))
    off, dist = F.abs(F.col("ay") - F.col("y")), F.col("ax") - F.col("x")
    pairs = asked.join(answers.hint("merge"), ["doc_id", "_gx", "_gy"]).filter((off < dy) & (dist > 0) & (dist < dx))
    start = F.struct(F.lit(9999.0).alias("off"), F.lit(9999.0).alias("dist"), F.lit(None).cast("string").alias("letter"))

    def better(acc, c):
        wins = (c["off"] < acc["off"] - slack) | ((F.abs(c["off"] - acc["off"]) <= slack) & (c["dist"] < acc["dist"]))
        return F.when(
            wins, F.struct(c["off"].alias("off"), c["dist"].alias("dist"), c["letter"].alias("letter"))
        ).otherwise(acc)

    # Only answers within dx by dy of one number come together here.
    best = pairs.groupBy("doc_id", "seq", "q", "x").agg(
        F.array_sort(F.collect_list(F.struct(
            "a_seq", off.cast("double").alias("off"), dist.cast("double").alias("dist"), "letter"
        ))).alias("_c")
    ).select("doc_id", "seq", "q", "x", F.aggregate("_c", start, better, lambda a: a["letter"]).alias("letter"))
    ones = (
        numbers.filter(F.col("q") == 1).groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.col("x").cast("double"))).alias("_ones"))
        .filter(F.size("_ones") >= min_columns)
    )
    middles = F.zip_with(
        F.slice("_ones", F.lit(1), F.size("_ones") - 1), F.slice("_ones", F.lit(2), F.size("_ones")), lambda a, b: (a + b) / 2
    )
    placed = best.join(ones.hint("merge"), "doc_id").withColumn(
        "column", F.size(F.filter(middles, lambda m: m <= F.col("x"))) + 1
    )
    return placed.groupBy("doc_id", "column", "q").agg(F.min_by("letter", "seq").alias("letter"))


def answer_key_unpivot(tables: DataFrame, level: str) -> DataFrame:
    """(q, letter) of one level from wide key tables.

    ``tables(doc_id, row_no, cells)``, the header in row 0.  Names are compared
    without ``-``, ``_`` and blanks.  A header repeated in the next column
    marks a number/answer pair; else the first column holds the numbers.  A table
    of two columns without the level is a plain list.
    """
    def bare(x):
        return F.regexp_replace(F.lower(F.trim(x)), r"[-_ ]", "")

    wanted = F.lit(level.lower().replace("-", "").replace("_", "").replace(" ", ""))
    names = F.transform("cells", bare)
    at = F.array_position(names, wanted)
    paired = F.try_element_at(names, (at + 1).cast("int")) == wanted
    plain = (at == 0) & (F.size("cells") == 2)
    heads = tables.filter(F.col("row_no") == 0).select(
        "doc_id",
        F.when(plain | ~F.coalesce(paired, F.lit(False)), 1).otherwise(at).cast("int").alias("_num"),
        F.when(plain, 2).when(F.coalesce(paired, F.lit(False)), at + 1).otherwise(at).cast("int").alias("_ans"),
    ).filter(F.col("_ans") > 0)
    rows = tables.filter(F.col("row_no") > 0).join(heads, "doc_id")
    q = F.trim(F.try_element_at("cells", F.col("_num"))).try_cast("int")
    letter = F.upper(F.trim(F.try_element_at("cells", F.col("_ans"))))
    return rows.select("doc_id", q.alias("q"), letter.alias("letter"), "row_no").filter(
        F.col("q").isNotNull() & F.col("letter").rlike("^[A-E]$")
    ).groupBy("doc_id", "q").agg(F.max_by("letter", "row_no").alias("letter"))
