"""Small golden scenes: 8 x 8 pixels of 10 m, with results known by hand."""

WATER, VEGETATION = (500.0, 1000.0, 300.0, 200.0), (500.0, 600.0, 400.0, 3000.0)
BUILT, OTHER = (500.0, 800.0, 900.0, 1000.0), (500.0, 800.0, 900.0, 1500.0)
PIXEL = "pair_id string, row int, col int, blue double, green double, red double, nir double"
PAIR = ("pair_id string, roles_before array<string>, roles_after array<string>, roles_optical array<string>, "
        "roles_radar array<string>, date_before string, date_after string, units string, a double, e double, f double")


def scene(spark, rows, swir=False, pair="p"):
    """``rows`` lists (number of rows, band recipe) from the top."""
    out, r = [], 0
    for count, bands in rows:
        for _ in range(count):
            for c in range(8):
                nir = bands[3]
                extra = ((1500.0 if nir == 1000 else 50.0 if nir == 200 else nir / 2),) if swir else ()
                out.append((pair, r, c, *bands, *extra))
            r += 1
    return spark.createDataFrame(out, PIXEL + (", swir1 double" if swir else ""))


def pairs(spark, roles=("blue", "green", "red", "nir"), after=None, radar=("vv",), units="metres", pair="p"):
    row = (pair, list(roles), list(after or roles), list(roles), list(radar), "2021-02-05", "2025-02-05", units, 10.0, -10.0, 1440000.0)
    return spark.createDataFrame([row], PAIR)


def radar(spark, half_zero=False, missing=None, pair="p"):
    out = []
    for r in range(8):
        for c in range(8):
            v = 0.005 if r < 2 else 0.5 if r < 4 else 0.05
            if (r, c) == (3, 7):
                v = 0.05
            if (r, c) == (7, 7):
                v = 0.005
            if half_zero and c < 4:
                v = 0.0
            out.append((pair, r, c, missing if missing is not None and c < 4 else v))
    return spark.createDataFrame(out, "pair_id string, row int, col int, vv double")
