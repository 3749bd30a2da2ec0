import public_tokenizers
import pytest
from tokenizers import Tokenizer

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="session")
def byte_library():
    return Tokenizer.from_file(BYTE)
