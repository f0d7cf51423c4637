from seqloom.llm.token_files import Encoder, default_tokenizer


def test_an_encoder_is_let_go_before_files_are_read():
    """What it remembers, and the tokenizer, aren't beside the frames that a worker reads back."""
    kept = Encoder.of(default_tokenizer())
    assert Encoder.of(default_tokenizer()) is kept
    Encoder.let_go()
    assert not Encoder._kept and Encoder.of(default_tokenizer()) is not kept
