import pytest

from latticework.schema import ArrayError, parse_schema


def test_parse_and_show():
    s = parse_schema("A<a:int64 null, b:string default 'x'> [x=1:6,6,0, y=0:*,10,2]")
    assert s.name == "A" and s.attr_names == ["a", "b"] and s.attr("a").nullable and s.attr("b").default == "'x'"
    assert (s.dim("x").lo, s.dim("x").hi, s.dim("y").hi, s.dim("y").overlap) == (1, 6, None, 2)
    assert parse_schema(str(s)) == s


def test_length_form_and_bare_dims():
    s = parse_schema("<v:double>[i=3, j]")
    assert s.dim("i").length == 3 and s.dim("j").hi is None


@pytest.mark.parametrize("text", ["<a:int64>", "<a:nothing>[i=0:1,2,0]", "<a:int64,a:int64>[i=0:1,2,0]", "<a:int64>[a=0:1,2,0]", "<a:int64>[]"])
def test_bad_schemas(text):
    with pytest.raises(ArrayError):
        parse_schema(text)
