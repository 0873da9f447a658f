"""Small matrices in the library's column names."""


def row(q, candidate, label, sim, anchor=None, context="C|N", target="T_KEEP"):
    d = 1.0 - sim
    return (q, anchor or f"A_{q}", candidate, label, sim, 0.5 * sim, d, 0.0, d, d, d, context, target)


SCHEMA = ("query_id string, anchor string, candidate string, label int, sim double, phi double, d1 double, d2 double, "
          "d3 double, d4 double, d5 double, context string, target string")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def separable(spark):
    """6 anchors x 4 queries x 5 candidates with one clearly best candidate each."""
    rows = []
    for a in range(6):
        for q in range(4):
            for c, name in enumerate(["C_GOOD", "C_NEAR", "C_BAD1", "C_BAD2", "C_BAD3"]):
                y = int(c == a % 2)
                far = 0.0 if y else 1.0
                rows.append((f"A{a}_q{q}", f"A{a}", name, y, 0.9 if y else 0.2 + 0.02 * c, 0.85 if y else 0.05 * c,
                             far * (3.0 + c), far, 0.05 + 0.45 * far, 0.05 + 0.35 * far, 0.05 + 0.35 * far, "x", "t"))
    return frame(spark, rows)
