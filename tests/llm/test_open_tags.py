"""Pages without optional end tags."""

import pytest

from skillgrid.llm import html_cut
from skillgrid.llm.html_cut import PRIOR


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>x</title><body><article><p>Some text here.</article>",
        "<head><title>x</title><meta charset=utf-8><link rel=a><article><p>Some text here.</article>",
        "<body><div><select><option>a<option>b<article><p>Some text here.</article></div>",
        "<body><div><button>Go<p>Some text here.</div>",
        "<head><title>x</title>Some text here.",
        "<head><script>var a = 1;</script><style>p {}</style></head><body><p>Some text here.",
    ],
)
def test_text_after_open_elements(html):
    assert [b[0] for b in html_cut.blocks_of(html)] == ["Some text here."]


def test_silent_elements_stay_silent():
    assert html_cut.blocks_of("<head><title>x</title><script>1</script><style>2</style><body><template><p>no</template>") == []
    assert html_cut.main_text("<head><title>x</title><script>1</script><style>2</style><body><form><p>Name</form><template><p>no</template>", PRIOR) == ""
