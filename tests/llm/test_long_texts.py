import os
import time

import pytest

from relayscope.llm import encoding, leaks, mojibake, pii, subjects

KNOWN = pii.NameKnowledge(bytes(pii.BITS // 8), bytes(pii.BITS // 8))
ODD = ["a", " ", "\n", "-\n", "1", "1 ", "a@", "a.", "(1) ", "<", "<a ", "> ", "-- \nx y\n", "A B. ", "éà", "Рі", "&a;", "�", "Received: from ", "P.S. ", "if ( {", "ab12 ", "a:"]


@pytest.mark.parametrize("kernel", [lambda t: pii.mask(t, KNOWN, b"k"), mojibake.read_value.__wrapped__, leaks.words_of, subjects.sentences], ids=["mask", "mojibake", "words", "sentences"])
def test_no_text_takes_more_than_its_length(kernel):
    for part in ODD:
        text = (part * 100_000)[:60_000]
        began = time.process_time()
        kernel(text)
        assert time.process_time() - began < 8, part


@pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_VOCABULARY), reason="no vocabulary here")
def test_nor_does_the_encoder():
    encoder = encoding.WordEncoder(encoding.Vocabulary(encoding.DEFAULT_VOCABULARY))
    for part in ODD:
        began = time.process_time()
        encoder.encode([(part * 100_000)[:60_000]])
        assert time.process_time() - began < 8, part
