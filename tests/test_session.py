import pytest

from subscope.session import one_process


@pytest.mark.parametrize("master, alone", [
    ("local", True), ("local[8]", True), ("local[*,3]", True), ("local-cluster[2,1,1024]", False),
    ("yarn", False), ("spark://host:7077", False),
])
def test_only_one_process_may_stage_locally(master, alone):
    assert one_process(master) is alone
