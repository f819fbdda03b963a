import pytest
from test_copydiff import found, row


@pytest.mark.parametrize(
    ("a", "b", "fields"),
    [
        ({"reward": 0.02}, {"reward": 20000.0}, {"reward"}),
        ({"qpos": (0.02, -0.5)}, {"qpos": (20000.0, -500000.0)}, {"qpos"}),
        ({"qpos": (1e300, 20000.0)}, {"qpos": (1e300, 20000.0)}, set()),
        ({"qpos": (None, 0.0)}, {"qpos": (0.0, 20000.0)}, {"qpos"}),
        ({"reward": 9999.9999999}, {"reward": 10000.0}, set()),
    ],
)
def test_a_number_is_no_grid_cell(spark, a, b, fields):
    assert found(spark, [row(**a)], [row(**b)]) == {("p", 0, f) for f in fields}
