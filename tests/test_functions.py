"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from chromatid.functions import colors, ids, spacing, strings


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda c: frame.select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("function", "given", "want"),
    [
        (strings.component_key, "My-Button_Component", "mybutton"),
        (strings.token_key, "Brand.primary-500", "brandprimary500"),
        (strings.dotted_name, "Brand-primary_500", "brand.primary.500"),
        (strings.comparison_key, "IButtonContainer", "button"),
        (strings.comparison_key, "AbstractCard", "card"),
        (strings.naming_pattern, "button", "camelCase"),
        (strings.naming_pattern, "my-button", "kebab-case"),
        (strings.naming_pattern, "my_button", "snake_case"),
        (strings.naming_pattern, "MyButton2", "PascalCase"),
        (strings.naming_pattern, "9x", "other"),
        (strings.base_name, "ButtonV2", "button"),
        (strings.base_name, "ButtonGroup", "buttongroup"),
        (strings.base_name, "CardLegacy", "card"),
        (strings.class_pattern, " flex  items-center gap-2 ", "flex gap-2 items-center"),
        (strings.tight_class_pattern, "p-4 shadow-lg rounded text-sm custom", "custom {p} {rounded} {shadow} {text}"),
        (strings.css_variable, "color.primaryText", "--color-primary-text"),
        (strings.css_variable, "--kept", "--kept"),
        (strings.package_name, "@org/pkg/deep", "@org/pkg"),
        (strings.package_name, "react/jsx", "react"),
        (strings.is_token_reference, "var(--x)", True),
        (strings.is_token_reference, "#fff", False),
        (strings.is_interactive, "IconButton", True),
        (ids.hash_hex, "", "0"),
        (spacing.to_px, "1.5rem", 24.0),
        (spacing.to_px, "-4px", -4.0),
        (spacing.to_px, "auto", None),
        (lambda c: colors.normal_color(c), "#ABC", "#aabbcc"),
        (lambda c: colors.normal_color(c), "rgba(255, 0, 16, 0.5)", "#ff0010"),
        (lambda c: colors.normal_color(c), "hsl(120, 100%, 25%)", "#008000"),
        (lambda c: colors.normal_color(c), "hsl(0, 0%, 100%)", "#ffffff"),
        (lambda c: colors.normal_color(c), "tomato", "#ff6347"),
        (lambda c: colors.normal_color(c), "#11223344", "#112233"),
        (lambda c: colors.normal_color(c), "nonsense", None),
        (lambda c: colors.normal_color(c, "fix"), "nonsense", "nonsense"),
        (lambda c: colors.normal_color(c, "import"), "#AbC", "#aabbcc"),
        (lambda c: colors.normal_color(c, "scanner"), "#AbC", "#abc"),
    ],
)
def test_values(one, function, given, want):
    assert one(function(F.lit(given))) == want


def test_hash_wraps_like_32_bits(one):
    text = "drift-signal:Button:" * 9
    h = 0
    for c in text:
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert one(ids.rolling_hash(F.lit(text))) == h
    assert one(ids.stable_drift_id(F.lit("t"), F.lit("E"), F.lit(None), F.lit(""), F.lit("a"))).startswith("drift:t:E:")


def test_similarity(one):
    assert one(strings.similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(strings.similarity(F.lit(""), F.lit(""))) == 1
    assert one(strings.similarity(F.lit("日本"), F.lit("中国"))) == 0


def test_color_scores(one):
    assert one(colors.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21)
    assert one(colors.color_confidence(F.lit("#FF0000"), F.lit("#ff0000"))) == 100
    assert 97 < one(colors.color_confidence(F.lit("#ff0001"), F.lit("#ff0000"))) < 98
    assert one(colors.color_confidence(F.lit("#00ff00"), F.lit("#ff0000"))) == 20
    assert one(colors.differing_digits(F.lit("#ff0001"), F.lit("#ff0000"))) == 1
    assert one(spacing.spacing_confidence(F.lit(15.0), F.lit(16.0))) == 98
    assert one(spacing.spacing_confidence(F.lit(80.0), F.lit(100.0))) == 50


def test_name_scores(one):
    score = lambda a, b: one(strings.name_match_score(F.lit(a), F.lit(b)))
    assert score("Button", "button") == 100 and score("IconButton", "button") == pytest.approx(70 + 50 * 6 / 10)
    assert score("card header", "header-x") == pytest.approx(50 + 30 / 2) and score("abc", "xyz") == 0


def test_locations(one):
    assert one(strings.location_parts(F.lit("src/a.tsx:12:3"))).asDict() == {"file": "src/a.tsx", "line": 12, "column": 3}
    assert one(strings.location_parts(F.lit("src/a.tsx:12"))).asDict() == {"file": "src/a.tsx", "line": 12, "column": None}
    assert one(strings.location_parts(F.lit("nowhere"))).file is None
