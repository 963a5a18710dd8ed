import pytest

from shelfmetrics.functions.packsize import extract_pack_sizes

CASES = [
    # title, details, count, size, unit, confidence
    ("Oat bars, 12 count", {}, 1, 12, "ct", 0.8),
    ("Shampoo 250 ml", {}, 1, 250, "ml", 0.8),
    ("Broth 6 x 1.5 l", {}, 6, 1.5, "l", 0.8),
    ("Rice, 2 lb (pack of 3)", {}, 3, 2, "lb", 0.8),
    ("Cloths, 3 packs of 20", {}, 3, 20, "ct", 0.8),
    ("Tea 60's", {}, 1, 60, "ct", 0.8),
    ("Flour 1,200 g", {}, 1, 1200, "g", 0.8),
    ("Whey 2 lb, 25g of protein", {}, 1, 2, "lb", 0.8),
    ("Oil 8 fl oz", {"Size": "8 Fl Oz"}, 1, 8, "fl oz", 0.95),
    ("Plain soap", {"Size": "4 Ounces", "Unit Count": "4 Ounces"}, 1, 4, "oz", 0.85),
    ("Plain soap", {"Size": "1/2 Pounds"}, None, None, None, 0.4),
    ("Plain soap", {"Sheet Count": "80"}, 1, 80, "ct", 0.75),
]
ABSTAIN = [
    ("Travel kit, 3 oz", {}, "title_is_kit", 0.0),
    ("Steel mug 12 oz", {}, "no_size_found", 0.0),
    ("Bars 2 oz and 7 oz", {}, "title_conflicting_weight", 0.3),
    ("Drops 2 ml and 9 ml", {}, "title_conflicting_volume", 0.3),
    ("Wipes 30 count 70 wipes", {}, "title_conflicting_counts", 0.3),
    ("Soap pack of 2, set of 5", {}, "title_conflicting_pack_counts", 0.3),
    ("Bars 2.1 oz, 10 count", {}, "title_size_count_ambiguous", 0.6),
    ("Gel 3 oz", {"Size": "9 Pounds"}, "sources_disagree", 0.3),
    ("Gel 3 oz 80 ml", {}, "sources_disagree", 0.3),
    ("Plain soap", {"Number of Items": "4"}, "only_weak_sources", 0.4),
    ("Plain soap, pack of 5", {"Unit Count": "12 Count"}, "sources_disagree", 0.3),
    ("Odd 1/0 oz", {}, "no_size_found", 0.0),
    ("Plain soap", {"Unit Count": "1 Count"}, "no_size_found", 0.0),
    (None, None, "no_size_found", 0.0),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(k, t, d) for k, (t, d, *_) in enumerate(CASES + ABSTAIN)]
    return {r["k"]: r for r in extract_pack_sizes(spark.createDataFrame(rows, "k int, title string, details map<string,string>")).collect()}


def test_sizes(extracted):
    for k, (title, _, count, size, unit, confidence) in enumerate(CASES):
        row = extracted[k]
        assert round(row["confidence"], 2) == confidence, title
        if count:
            assert (row["pack"]["count"], row["pack"]["size"], row["pack"]["unit"]) == (count, size, unit), title
            assert row["flag"] is None


def test_abstentions(extracted):
    for k, (title, _, flag, confidence) in enumerate(ABSTAIN, len(CASES)):
        assert (extracted[k]["pack"], extracted[k]["flag"], extracted[k]["confidence"]) == (None, flag, confidence), title


# every way of writing a unit, with what it means
WRITTEN = {
    "fl oz": "fl oz|fl. oz.|floz|FL OZ|fluid ounce|Fluid Ounces|fl. ounces", "oz": "oz|oz.|OZ|ounce|Ounces", "lb": "lb|lb.|lbs|LBS.|pound|pounds", "kg": "kg|kgs|kilogram|Kilograms", "g": "g|gr|gram|grams|G",
    "ml": "ml|ML|milliliter|milliliters|millilitre|millilitres", "l": "l|L|ltr|liter|litres|Liters", "gal": "gal|gallon|gallons", "qt": "qt|quart|quarts", "pt": "pt|pint|pints",
}
# everything that is counted
NOUNS = (
    "count|ct|Ct|capsule|capsules|caps|vcaps|veg caps|veggie caps|vegcaps|veggiecapsules|tablet|tablets|tabs|caplet|caplets|softgel|softgels|soft gels|gummies|gummy|pieces|pcs|pc|bags|wipes|sheets|pods|packets|sachets|"
    "sticks|lozenges|rolls|towelettes|pads|liners|napkins|cups|plates|bars|chews|lollipops|patches|strips|swabs|tampons|diapers|pairs|refills|cartridges|filters|batteries|ea|each"
).split("|")
SHAPES = [("Thing 7 {u}", 1, 7), ("Thing 7{u} blue", 1, 7), ("Thing, 2.5-{u}", 1, 2.5), ("Thing 3 x 7 {u}", 3, 7), ("Thing 7 {u} (Pack of 4)", 4, 7)]
# title, details, count, size, unit, confidence
READ = [
    *[(shape.format(u=u), {}, count, size, unit, 0.8) for unit, ways in WRITTEN.items() for u in ways.split("|") for shape, count, size in SHAPES],
    *[(f"Thing 15 {noun}", {}, 1, 15, "ct", 0.8) for noun in NOUNS],
    *[(f"Thing 2 x 15 {noun}", {}, 2, 15, "ct", 0.8) for noun in ("count", "wipes", "pack", "pk")],
    *[(f"Thing 4 {word} of 25", {}, 4, 25, "ct", 0.8) for word in ("pack", "packs", "box" + "es", "bottles", "tubes", "cans", "jars", "bags")],
    *[(f"Thing 5 oz, {word} of 6", {}, 6, 5, "oz", 0.8) for word in ("pack", "set", "case", "bundle", "lot")],
    *[(f"Thing 5 oz 4{word}", {}, 4, 5, "oz", 0.8) for word in (" pack", "-pack", "pk", " packs")],
    *[(f"Tea 20/{word}", {}, 1, 20, "ct", 0.8) for word in ("bag", "box", "pack", "case", "bottle", "roll")],
    *[(f"Tea, {word} of 40", {}, 1, 40, "ct", 0.8) for word in ("box", "bag", "tub", "jar", "bottle")],
    *[(f"Whey 2 lb, 25g {word}", {}, 1, 2, "lb", 0.8) for word in ("protein", "of sugar", "fiber", "fibre", "carbs", "net carbs", "fat", "of collagen", "creatine")],
    ("Tea 100s", {}, 1, 100, "ct", 0.8), ("Tea 9's", {}, 1, 9, "ct", 0.8), ("Broth 4×1.5 l", {}, 4, 1.5, "l", 0.8), ("Broth 4*250 ml", {}, 4, 250, "ml", 0.8), ("Beads 1,000 ct", {}, 1, 1000, "ct", 0.8),
    ("Cream 1/2 oz", {}, 1, 0.5, "oz", 0.8), ("Soap 30 pack", {}, 1, 30, "ct", 0.8), ("Bars 12 oz, 24 oz total, pack of 2", {}, 2, 12, "oz", 0.8), ("Bars 12 oz 12 oz", {}, 1, 12, "oz", 0.8), ("Oil 16 oz (1 lb)", {}, 1, 16, "oz", 0.8),
    # details: fields of sizes, volumes and counts, in the standard form or not
    ("Soap", {"Size": "12 Count (Pack of 2)"}, 2, 12, "ct", 0.75), ("Soap", {"Unit Count": "32 Fl Oz"}, 1, 32, "fl oz", 0.75), ("Soap", {"Unit Count": "16.0 Ounce"}, 1, 16, "oz", 0.75),
    ("Soap", {"Item Volume": "250 Milliliters"}, 1, 250, "ml", 0.75), ("Soap", {"Liquid Volume": "8 Fluid Ounces"}, 1, 8, "fl oz", 0.75), ("Soap", {"Volume": "2 Liters"}, 1, 2, "l", 0.75), ("Soap", {"Number of Pieces": "6"}, 1, 6, "ct", 0.75),
    ("Soap", {"Size": "6 Count", "Number of Pieces": "6"}, 1, 6, "ct", 0.85), ("Juice 12 fl oz (pack of 6)", {"Liquid Volume": "12 Fluid Ounces"}, 6, 12, "fl oz", 0.95), ("Wipes 80 count", {"Unit Count": "80 Count", "Number of Items": "80"}, 1, 80, "ct", 0.95),
    ("Steel mug", {"Unit Count": "4 Count"}, 1, 4, "ct", 0.75), ("Bars 2 oz, 10 count", {"Unit Count": "20 Ounces"}, 10, 2, "oz", 0.95), ("Soap", {"Size": "One Size", "Sheet Count": "12"}, 1, 12, "ct", 0.75),
    # known quirks: a count that is a pack as well, mixed numbers, units after "of", years
    ("Soap 8 count pack", {}, 8, 8, "ct", 0.8), ("Nuts 1 1/2 oz", {}, 1, 0.5, "oz", 0.8), ("Cola 24 cans of 12 oz", {}, 24, 12, "ct", 0.8), ("Hits of the 1990s", {}, 1, 1990, "ct", 0.8), ("Gel 0 oz", {}, 1, 0, "oz", 0.8),
    # what holds something is told by the normalised title for amounts in it, and by the title as it is for details
    ("Spray 5g fat bottles 12 oz", {"Size": "12 Ounces"}, 1, 12, "oz", 0.75),
]
UNREAD = [
    *[(f"Blue {word} 12 oz", {}, "no_size_found", 0.0) for word in ("cup", "glasses", "container", "tumbler", "mugs", "bowl", "lid", "trash bags", "can liner", "bucket", "pitcher", "flask", "shaker", "dispenser", "spray bottle", "empty tin", "water bottle", "sleeve")],
    ("Soap 12 pack", {}, "no_size_found", 0.0), ("Soap 5ozen", {}, "no_size_found", 0.0), ("A5 oz of x", {}, "no_size_found", 0.0), ("Steel mug", {"Size": "12 oz"}, "no_size_found", 0.0), ("Box includes 3 oz", {}, "title_is_kit", 0.0),
    ("Soap", {"Number of Pieces": "²"}, "no_size_found", 0.0), ("Soap", {"Number of Pieces": "1"}, "no_size_found", 0.0), ("Soap", {"Number of Pieces": "six"}, "no_size_found", 0.0), ("Soap", {"Item Package Quantity": "3"}, "only_weak_sources", 0.4),
    ("Soap", {"Size": "12 oz bottle"}, "only_weak_sources", 0.4), ("Soap", {"Size": "0/0 oz"}, "no_size_found", 0.0), ("Gel 3 oz 80 ml", {}, "sources_disagree", 0.3), ("Soap 5 oz, pack of 2, set of 3", {}, "title_conflicting_pack_counts", 0.3),
    ("Bars 2 oz, 10 count", {"Size": "2 Ounces"}, "sources_disagree", 0.3),
]


def test_readings_by_the_book(spark):
    assert len(READ) + len(UNREAD) > 200
    rows = [(k, t, d) for k, (t, d, *_) in enumerate([*READ, *UNREAD])]
    found = {r["k"]: r for r in extract_pack_sizes(spark.createDataFrame(rows, "k int, title string, details map<string,string>")).collect()}
    wrong = []
    for k, (title, details, *want) in enumerate([*READ, *UNREAD]):
        r = found[k]
        p = r["pack"]
        got = [p["count"], p["size"], p["unit"], round(r["confidence"], 2)] if p else [r["flag"], round(r["confidence"], 2)]
        if got != want:
            wrong.append((title, details, got, want))
    assert not wrong, "\n".join(map(str, wrong))
