"""leafgrid: hyperspectral field imagery and its tabular work as lazy PySpark DataFrame operators."""
