"""What workers keep between tasks goes with the first task of another operator."""

from sieveline.llm import language_id, token_file
from sieveline.llm.common import releasing
from sieveline.llm.queries import tokenizer_path


def test_another_operator_lets_go_of_what_tasks_kept():
    token_file.encoder(tokenizer_path())
    list(releasing(token_file._decoded)(iter([])))
    assert token_file._ENCODERS
    language_id._letters()
    assert language_id._LETTERS

    def other(batches):
        assert not token_file._ENCODERS and not language_id._LETTERS
        yield from batches

    assert list(releasing(other)(iter([]))) == []
