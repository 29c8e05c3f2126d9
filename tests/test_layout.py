import os

import panelyard


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(panelyard.__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "panelyard.llm" not in f.read(), name
