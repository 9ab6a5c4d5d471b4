from ledgerloom.functions import unitgrammar as g
from ledgerloom.operators import units

import pytest


@pytest.mark.parametrize(
    "text,common,expected",
    [
        ("Rs. Crores", "crore", (1.0, "INR")), ("thousand cr", "crore", (1e3, "INR")), ("₹ lakh crore", "crore", (1e5, "INR")), ("Rs '000", "crore", (1e-4, "INR")),
        ("US$m", "crore", (0.1, "USD")), ("in full rupees", "crore", (1e-7, "INR")), ("€ million", "crore", (0.1, "EUR")), ("Rs 10^7", "crore", (1.0, "INR")),
        ("Paise per share", "rs", (0.01, "INR")), ("INR/share", "rs", (1.0, "INR")), ("bps", "%", (0.01, None)), ("ratio (0 to 1)", "%", (100.0, None)),
        ("%", "x", (0.01, None)), ("m", "days", (30.0, None)), ("m", "crore", (0.1, "INR")), ("wks", "days", (7.0, None)), ("no. of days", "days", (1.0, None)),
        ("as stated", "crore", (None, None)), ("n.a.", "crore", (None, None)), ("-", "%", (None, None)), ("", "%", (None, None)), (None, "%", (None, None)),
        ("growth of 2.5%", "x", (None, None)), ("see note 20", "crore", (None, None)), ("x" * 500, "x", (None, None)),
    ],
)
def test_unit_strings(text, common, expected):
    value, currency = g.factor([g.read_unit(text, g.COMMON[common][0])], common)
    assert (None if value is None else pytest.approx(value)) == expected[0] and currency == expected[1]


@pytest.mark.parametrize(
    "text,figure,common,expected",
    [
        ("we guide for US$ 2.25 million of Operating profit.", 2.25, "crore", (0.1, "USD")),
        ("Rs 8.42-9.15 crore, weak demand.", 8.42, "crore", (1.0, "INR")), ("Rs. 946 to 1,068.05 lacs by Q4", 946.0, "crore", (0.01, "INR")),
        ("close to INR 1,34,09,00,000 only by Q2 FY25.", 1340900000.0, "crore", (1e-7, "INR")), ("EBITDA margin reached 0.2113 as a fraction.", 0.2113, "%", (100.0, None)),
        ("Against 9.5% last time, it is now at 13.3 times after", 13.3, "x", (1.0, None)), ("guide for 3,479 paise per share of", 3479.0, "rs", (0.01, "INR")),
        ("at 6.98x by Q3 FY18.", 6.98, "x", (1.0, None)), ("1,030 bps.", 1030.0, "%", (0.01, None)), ("nothing here", 5.0, "%", (None, None)),
    ],
)
def test_figures_in_sentences(text, figure, common, expected):
    value, currency = g.factor([g.read_figure(text, figure, g.COMMON[common][0])], common)
    assert (None if value is None else pytest.approx(value)) == expected[0] and currency == expected[1]


def test_nothing_is_too_long_to_be_read():
    assert g.factor([g.read_unit("figures in " * 50 + "Rs lakh", "money")], "crore") == (pytest.approx(0.01), "INR")
    assert g.read_label("Revenue from operations of the group " * 6 + "in the home market, in Rs lakh", "money") == g.Reading(1e5, "INR")
    assert g.read_label("Revenue, USD in millions", "money") == g.Reading(1e6, "USD") and g.read_label("(in crore)", "money").empty
    long = "Growth was steady in the home market. " * 30
    assert g.read_figure(long + "Revenue was US dollars      41.5" + " " * 90 + "million." + long, 41.5, "money") == g.Reading(1e6, "USD")
    assert g.read_figure("Rs 60 crore and $ 5 million", 60.0, "money") == g.Reading(1e7, "INR")


def test_sentences_are_segmented_like_unit_strings():
    """The words after a figure go through the same segmentation, whose end is open."""
    assert [x.value for x in g.segment("4 lakh crore in all", "money", 1, open_end=True)[0]] == [1e5, 1e7]
    assert g.segment("4 of the per share in", "money", 1, open_end=True)[0] == [] and g.segment("5 m away", "time", 1, open_end=True)[0][0].value == 30.0
    assert g.segment("5 m away", "money", 1, open_end=True)[0][0].value == 1e6 and g.segment("5 days late", "money", 1, open_end=True)[0] == []


def test_fields_complete_each_other():
    d = "money"
    assert g.factor([g.read_unit("INR", d), g.read_label("Revenue in Cr", d)], "crore") == (1.0, "INR")
    assert g.factor([g.read_unit("USD", d), g.read_unit("Amounts in million unless stated", d)], "crore") == (pytest.approx(0.1), "USD")
    assert g.read_label("Debtor days, weeks", "time").root == 7.0
    assert g.read_label("Debtor days", "time").empty and g.read_label("Earnings per share", d).empty


ROWS = "row_id bigint, sub_type string, metric string, year int, period string, value double, value_col string, unit string, raw_row map<string,string>, factor double"
CLAIMS = "claim_id bigint, sub_type string, metric string, value_low double, unit string, year int, source_text string"


def test_records(spark):
    kinds = spark.createDataFrame([("revenue", "x", "crore"), ("eps", "x", "rs")], "sub_type string, value_col string, common_unit string")
    rows = spark.createDataFrame(
        [
            (1, "revenue", "Revenue", 2024, "2024-03-31", 5.0, "sales", "lakh", None, 0.0), (1, "revenue", "Revenue", 2024, "2024-03-31", 5.0, "sales", "lakh", None, 0.0),
            (2, "revenue", "Revenue", None, "2023-12-31", 5.0, "sales", None, {"sales": "5", "scale": "$ mn"}, 0.0), (3, "revenue", "Revenue", 2024, None, 5.0, "sales", "Cr", {}, 0.0),
            (4, "revenue", "Revenue", 2024, None, None, "sales", "lakh", {}, 0.0), (5, "other", "Other", 2024, None, 1.0, "o", "lakh", {}, 0.0), (6, None, None, None, None, 1.0, None, None, None, None),
            (7, "revenue", "", 2024, None, 7.0, "sales", "", {"remark": "growth of 3%"}, 0.0),
        ],
        ROWS,
    )
    claims = spark.createDataFrame([(1, "eps", "EPS", 12.0, "per share", None, "We expect Rs 12 per share in FY24."), (2, "eps", "EPS", 12.0, None, None, None), (3, "eps", "EPS", 90.0, "", 2024, "EPS was 90 paise.")], CLAIMS)
    named = units.named_units(rows, claims, kinds)
    assert {tuple(r) for r in units.in_other_units(named).collect()} == {("metric_rows", 1), ("metric_rows", 2), ("concall_claims", 3)}
    fx = spark.createDataFrame([("USD", 2024, 80.0)], "currency string, year int, inr_per_unit double")
    got = {(r.source_table, r.record_id): r.common_value for r in units.to_common_units(named, fx).collect()}
    assert got[("metric_rows", 1)] == pytest.approx(0.05) and got[("metric_rows", 2)] == pytest.approx(40.0) and got[("metric_rows", 7)] == 7.0 and got[("concall_claims", 3)] == pytest.approx(0.9)
    assert units.in_other_units(units.named_units(rows.limit(0), claims.limit(0), kinds)).count() == 0
