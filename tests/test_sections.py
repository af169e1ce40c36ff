"""Ends of sections, in one pass over the headings."""

from sparkquire.operators.manifest import headed


def test_section_ends_need_no_frame_that_is_summed_up_anew_for_each_row(spark):
    levels = [1, 2, 3, 2, 6, 4, 1, 3, 3, 2]
    rows = spark.createDataFrame([("d", 2 * k, "#" * n + f" t{k}") for k, n in enumerate(levels)] + [("d", 2 * k + 1, "text") for k in range(len(levels))], "doc_id string, line_no long, line string")
    found = headed(rows)
    ends = [next((2 * j for j in range(k + 1, len(levels)) if levels[j] <= n), 2 * len(levels)) for k, n in enumerate(levels)]
    assert [r.end_line for r in found.orderBy("line_no").collect()] == ends
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
