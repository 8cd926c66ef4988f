import pytest

from kinmatch.llm.personal_data import automaton, find_spans


@pytest.mark.parametrize(
    "text, found",
    [
        ("Account no. 1234 5678 9012, thanks", ["1234 5678 9012"]),
        ("account 12345678 9012 is open", ["12345678 9012"]),
        ("acct # 12-345678-9 closed", ["12-345678-9"]),
        ("Account 123456 on hold", ["123456"]),
        ("Account no. AB12 CDEF 3456 7890", ["AB12 CDEF 3456 7890"]),
        ("Account no. 1234 567890123", ["1234 567890123"]),
        ("account 12 is full", []),
        ("pay DE89 3704 0044 0532 0130 00 today", ["DE89 3704 0044 0532 0130 00"]),
        ("BE68 5390 0754 7034 PAID", ["BE68 5390 0754 7034"]),
        ("IBAN: GB82WEST12345698765432 and (GB82 WEST 1234 5698 7654 32)", ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"]),
        ("DE89 3704 0044 0532 0130 01 fails its digits, XDE89370400440532013000 starts inside a word", []),
    ],
)
def test_accounts(text, found):
    assert [text[a:b] for kind, a, b in find_spans(text, automaton()) if kind == "account"] == found
