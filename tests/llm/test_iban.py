"""IBANs that stand in what an earlier match swallows."""

import pytest

from quarry.llm import pii

DE, GB = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"


@pytest.mark.parametrize("text,want", [
    (f"{DE} {GB}", [DE, GB]),
    ("REF AB12 DE89370400440532013000", ["DE89370400440532013000"]),
    (f"{GB} {DE} {GB}", [GB, DE, GB]),
    ("AB12 " * 2000 + DE, [DE]),
    ("AB12 CD34 EF56 GH78 IJ90", []),
])
def test_ibans(text, want):
    assert [text[a:b] for a, k, b in pii.spans(text) if pii.KINDS[k] == "iban"] == want
