"""Surrogates: nothing real is left, one entity has one surrogate, two entities never share one, formats stay."""

import random
import re

from pyspark.sql import functions as F

from clientscope.llm import pii

TEXT = (
    "Mrs Anna Schmidt met Mr. Schmidt, MRS ANNA SCHMIDT and Госпожа Иванова. Call +1 (743) 555-3824 or +1-743-555-3824, "
    "card 4111 1111 1111 1111 or 4111111111111111, a@b.example, A@B.EXAMPLE, 123-45-6789, 10.0.0.1."
)


def test_formats_and_coreference(spark):
    frame = spark.createDataFrame([(1, TEXT), (2, "Again a@b.example and Frau Schmidt.")], "doc_id long, text string")
    one, two = sorted(pii.replace_entities(frame, "k").collect())
    kinds = [m.kind for m in one.found]
    assert kinds == ["person"] * 4 + ["phone"] * 2 + ["card"] * 2 + ["email"] * 2 + ["ssn", "ip"]
    shape = re.match(
        r"Mrs (\w+ \w+) met Mr\. (\w+), MRS ([A-Z]+ [A-Z]+) and Госпожа ([А-Я][а-я]+)\. Call (\+\d \(\d{3}\) \d{3}-\d{4}) or (\+\d-\d{3}-\d{3}-\d{4}), "
        r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}), ([a-z0-9.]+@[a-z0-9.]+), ([A-Z0-9.]+@[A-Z0-9.]+), \d{3}-\d{2}-\d{4}, [\d.]+\.$",
        one.text,
    )
    assert shape, one.text
    name, _, loud, _, phone, phone2, card, card2, mail, mail2 = shape.groups()
    digits = lambda x: re.sub(r"\D", "", x)
    assert name.upper() == loud and digits(phone) == digits(phone2) and digits(card) == card2 and mail.upper() == mail2
    each = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(card2))]
    assert sum(d - 9 if d > 9 else d for d in each) % 10 == 0
    assert mail in two.text
    again = sorted(pii.replace_entities(frame, "k").collect())
    assert again == [one, two] and sorted(pii.replace_entities(frame, "other").collect()) != again


def test_collisions_are_drawn_again(spark):
    """4096 of 10,000 numbers of four digits: almost every attempt meets taken ones."""
    entities = spark.range(0, 4096).select(
        F.lit("phone").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("core"), F.lit("").alias("gender"), F.lit("").alias("script")
    )
    made = pii.assign(entities.where("id % 4 = 0"), "k").collect()
    new = [r.new_core for r in made]
    assert len(new) == len(set(new)) == 1024 and not set(new) & {r.core for r in made} and all(len(x) == 4 for x in new)


PEOPLE = [("Anna", "f"), ("Maria", "f"), ("Jane", "f"), ("John", "m"), ("Otto", "m"), ("Karl", "m")]
SURNAMES = ["Schmidt", "O'Brien", "Smith-Jones", "García", "Doe", "Müller", "Lee"]


def made_texts():
    """Texts with every way of naming a person, and numbers and addresses in several forms; what must go, and who is who."""
    rng, out = random.Random(4), []
    for i in range(60):
        given, sex = rng.choice(PEOPLE)
        last = rng.choice(SURNAMES)
        title = rng.choice({"f": ["Mrs", "Frau", "Dr. Frau", "Ms."], "m": ["Mr", "Herr", "Mr.", "Dr. Herr"]}[sex])
        middle = rng.choice(["", " B.", " Luise"])
        n = [rng.randrange(10) for _ in range(10)]
        phone = "".join(map(str, n))
        text = (
            f"{title} {given}{middle} {last} came. Later {given} {last} and {last} spoke, {title} {given[0]}. {last} wrote, {title} {last} too. "
            f"call +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} or {phone[:3]}-{phone[3:6]}-{phone[6:]}, +44 20 7946 0{phone[:3]}, "
            f"from 192.168.{n[0]}.{n[1]}, 10.{n[2]}.0.{n[3]}, 172.20.{n[4]}.9, 127.0.0.1, 8.8.{n[5]}.{n[6]} or 2001:4860:{n[7]}::8888."
        )
        out.append((i, text, given, last, middle.strip(), phone, n))
    return out


def test_people_and_numbers_by_brute_force(spark):
    rows = made_texts()
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    made = {r.doc_id: r.text for r in pii.replace_entities(frame, "k").collect()}
    shape = re.compile(
        r"(?:(?:Mrs|Frau|Dr|Ms|Mr|Herr)\.? )+(?P<given>[A-ZÀ-Ý][\w']+)(?: (?P<middle>[A-Z]\.|[A-Z]\w+))? (?P<last>[\w'-]+) came\. Later (?P<g2>\S+) (?P<l2>\S+) and (?P<l3>\S+) spoke, "
        r"(?:(?:Mrs|Frau|Dr|Ms|Mr|Herr)\.? )+(?P<initial>[A-Z])\. (?P<l4>\S+) wrote, (?:(?:Mrs|Frau|Dr|Ms|Mr|Herr)\.? )+(?P<l5>\S+) too\. call \+1 \((?P<p1>\d{3})\) (?P<p2>\d{3})-(?P<p3>\d{4}) or "
        r"(?P<q1>\d{3})-(?P<q2>\d{3})-(?P<q3>\d{4}), \+44 \d\d \d{4} \d{4}, from 192\.168\.\d+\.\d+, 10\.\d+\.\d+\.\d+, 172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+, "
        r"127\.0\.0\.1, 2[45]\d\.\d+\.\d+\.\d+ or 2001:db8:[0-9a-f:]+\.$"
    )
    given_of, last_of, phone_of = {}, {}, {}
    for i, text, given, last, middle, phone, n in rows:
        new = made[i]
        for secret in (given, last, phone[:3] + ") " + phone[3:6], f"{phone[3:6]}-{phone[6:]}", f"192.168.{n[0]}.{n[1]}", f"8.8.{n[5]}.{n[6]}", ":8888", "Luise"):
            assert not re.search(rf"(?<!\w){re.escape(secret)}(?!\w)", new), (secret, new)
        m = shape.match(new)
        assert m, new
        assert m["l2"] == m["l3"] == m["l4"] == m["l5"] == m["last"] and m["g2"] == m["given"] and m["initial"] == m["given"][0]
        assert (m["middle"] is None) == (middle == "") and (m["p1"], m["p2"], m["p3"]) == (m["q1"], m["q2"], m["q3"])
        for table, old, value in ((given_of, given, m["given"]), (last_of, last, m["last"]), (phone_of, phone, m["p1"] + m["p2"] + m["p3"])):
            assert table.setdefault(old, value) == value
    for table in (given_of, last_of, phone_of):
        assert len(set(table.values())) == len(table) and not set(table.values()) & set(table)
    assert all(given_of[g].endswith("a" if sex == "f" else "us") for g, sex in PEOPLE if g in given_of)


def test_private_ranges_are_permuted(spark):
    frame = spark.range(65_536).select(F.concat(F.lit("192.168."), F.floor(F.col("id") / 256), F.lit("."), F.col("id") % 256).alias("ip"))
    made = frame.select("ip", pii.private_address("k", F.col("ip")).alias("new")).where("new rlike '^192[.]168[.][0-9]{1,3}[.][0-9]{1,3}$'")
    assert made.select("new").distinct().count() == 65_536 and made.where("ip = new").count() < 20


def test_cards_of_other_lengths(spark):
    rows = [(1, "378282246310005 and 3782 822463 10005 or 4222222222222, 6304000000000000000"), (2, "1234567890123 is no card, nor 378282246310006.")]
    one, two = sorted(pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect())
    assert [m.kind for m in one.found][:3] == ["card"] * 3 and "378282" not in one.text and "4222222222222" not in one.text
    whole, parted = re.match(r"(\d{15}) and (\d{4} \d{6} \d{5}) or \d{13}", one.text).groups()
    assert whole == parted.replace(" ", "") and two.text == rows[1][1]


def test_names_without_titles_stay_elsewhere(spark):
    rows = [(1, "Mrs Anna Maria Schmidt. Schmidts Katze, Schmidt!"), (2, "Anna Schmidt"), (3, "Mr von der Leyen und MR VON DER LEYEN"), (4, None), (None, "")]
    made = {r.doc_id: r.text for r in pii.replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert made[2] == rows[1][1] and made[4] is None and made[None] == ""
    m = re.match(r"Mrs (\w+) (\w+) (\w+)\. Schmidts Katze, (\w+)!$", made[1])
    assert m and m[3] == m[4] and "Schmidt " not in made[1]
    assert re.match(r"Mr von der [A-Z]\w+ und ", made[3]) and "Leyen" not in made[3] and "LEYEN" not in made[3]
