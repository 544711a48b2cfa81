from placeweave.functions.html import page_fields, read_page

PAGE = """<html><head><title>t</title></head><body><h1>Tiny <b>Tots</b></h1>
<div role="img" aria-label="4.3 stars"></div><span>(1,234 reviews)</span>
<button data-item-id="address" aria-label="Address: House 1,  F-7/3, Islamabad"></button>
<button data-item-id="phone:tel:0300" aria-label="Phone: 0300 1234567"></button>
<a href="https://www.google.com/x">g</a><a data-item-id="authority" href="https://tots.example/">site</a>
<div aria-label="Saturday, Closed; Sunday, Closed; Monday, 8 AM to 2 PM. Hide open hours for the week"></div>
<button jsaction="pane.rating.category">Day care center</button>
<div data-review-id="r1"><div data-review-id="r1"><span class="d4r55">Ann</span><span aria-label="5 stars"></span><span class="wiI7pd">Good &amp; kind</span><span class="rsqaWe">2 months ago</span></div></div>
<div data-review-id="r2"></div>
<img src="https://lh3.googleusercontent.com/p/abc=w203-h114-k-no" alt="front"><img src="https://lh3.googleusercontent.com/a/me=s64"><img src="https://lh3.googleusercontent.com/p/icon=w32-h32">
<div style="background-image: url('https://lh5.googleusercontent.com/gps-cs-s/xyz=s680')"></div>
<p>Permanently closed</p></body></html>"""


def test_page():
    got = read_page(PAGE)
    assert (got["name"], got["rating"], got["review_count"], got["closed"]) == ("TinyTots", 4.3, 1234, True)
    assert (got["address"], got["area"], got["phone"], got["website"]) == ("House 1, F-7/3, Islamabad", "F-7/3", "0300 1234567", "https://tots.example/")
    assert got["hours"] == {"Saturday": "Closed", "Sunday": "Closed", "Monday": "8 AM–2 PM"}
    assert got["categories"] == ["Day care center"]
    assert got["reviews"] == [{"author": "Ann", "rating": 5, "text": "Good & kind", "date": "2 months ago"}]
    assert [i["url"] for i in got["images"]] == ["https://lh3.googleusercontent.com/p/abc=w1200-h800", "https://lh5.googleusercontent.com/gps-cs-s/xyz=w1200-h800"]


def test_tiers():
    assert read_page('<span aria-hidden="true">4.1</span> 57 Google reviews')["rating"] == 4.1
    assert read_page('<script>{"averageRating": 3.9}</script>')["rating"] == 3.9
    assert read_page("<p>12 reviews, call 051-2345678</p>")["phone"] == "051-2345678"
    table = "<table><tr><td>Monday</td><td>9 to 5</td></tr><tr><td>x</td></tr></table>"
    assert read_page(table)["hours"] == {"Monday": "9 to 5"}
    assert read_page('<div>12 Mall Road, Lahore</div>')["address"] == "12 Mall Road, Lahore"


def test_column(spark):
    rows = spark.createDataFrame([(PAGE,), (None,), ("",), ("<div><p>broken",)], "html string").select(page_fields("html").alias("p")).select("p.*").collect()
    assert rows[0]["name"] == "TinyTots" and rows[0]["reviews"][0]["author"] == "Ann"
    assert all(r["name"] == "" and r["reviews"] == [] and r["hours"] == {} for r in rows[1:])
