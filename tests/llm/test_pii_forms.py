"""Numbers that look like phones and are none, on texts that the training windows' rules do not make."""

import datetime
import random

import pytest

from ebbmark.llm import pii, tagger

NO_PHONES = ["2024-05-12 13:44:59", "12.05.2024/0815/77", "978-3-16-148410-0", "0-306-40615-2", "2024-05-12 1344 59", "20240512-134459-01", "05/12/2024 13 44 59 12", "2024.05.12-000123-4"]
PHONES = ["+49 301 234 5678", "(301) 234-5678", "301-234-5678", "301.234.5678", "0049 301 2345678", "030/1234/5678", "978-3-16-148410-1"]


@pytest.mark.parametrize("s", NO_PHONES)
def test_dates_times_and_isbns_are_no_phones(s):
    assert not pii.plausible("phone", s) and not pii.plausible("card", s)


@pytest.mark.parametrize("s", PHONES)
def test_phones_stay_plausible(s):
    assert pii.plausible("phone", s)


@pytest.fixture(scope="module")
def model():
    return tagger.train(*pii.training_windows([]), 9, epochs=8, batch=64, rate=0.025)


def test_logs_and_book_lists_hold_no_phones(model):
    rng, lines = random.Random(41), []
    for i in range(300):
        t = datetime.datetime(2001, 1, 1) + datetime.timedelta(seconds=rng.randrange(10**9))
        stamp = rng.choice([f"{t:%Y-%m-%d %H:%M:%S}", f"{t:%d.%m.%Y %H:%M}", f"{t:%Y/%m/%d %H:%M:%S.%f}", f"[{t:%d/%b/%Y:%H:%M:%S} +0000]", f"{t:%Y%m%dT%H%M%SZ}"])
        lines.append(f"{stamp} {rng.choice(['INFO', 'WARN', 'DEBUG'])} worker-{i} finished {rng.randrange(9999)} rows in {rng.random():.3f} s")
    for i in range(100):
        nine = f"978{rng.randrange(10**9):09d}"
        d = nine + str(-sum(int(c) * (3 if j % 2 else 1) for j, c in enumerate(nine)) % 10)
        lines.append(f"The second edition appeared as {d[:3]}-{d[3]}-{d[4:6]}-{d[6:12]}-{d[12]} in the spring of {1990 + i % 30}.")
    assert not [s for spans in pii.spans_of(lines, model) for s in spans if s[0].startswith("seq_")]


def test_a_bracketed_dot_continues_the_domain(model):
    text = "Please write to jane [at] site [dot] co [dot] uk about the matter, and thank you for it."
    found = [text[a:b] for k, a, b in pii.spans_of([text], model)[0] if k == "seq_email"]
    assert found == ["jane [at] site [dot] co [dot] uk"]
