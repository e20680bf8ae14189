"""Texts are found by what two probes have unlike, not by a character that may stand elsewhere."""

import pytest
from reportloom.llm import chat


@pytest.mark.parametrize("role", ["user", "\ue000", "\ue001x\ue000", ""])
@pytest.mark.parametrize("text", ["hello", "", "\ue000", "a \ue001 b"])
def test_probe_characters_in_roles_and_texts(role, text):
    marked = lambda ts: "".join(f"<{r}\ue000>{t}</\ue001{r}>" for r, t in ts)
    out, spans, rewritten = chat.located(marked, [("system", "x"), (role, text)])
    assert not rewritten and [out[a:b] for _, _, a, b in spans] == ["x", text]
    out, spans, _ = chat.located(chat.default_template, [(role, text)])
    assert [chat.unescape(out[a:b]) for _, _, a, b in spans] == [text]


def test_templates_that_leave_texts_out():
    assert chat.located(lambda ts: "".join(f"{r};" for r, _ in ts), [("user", "hello")])[1] == [(0, 5, 5, 5)]
