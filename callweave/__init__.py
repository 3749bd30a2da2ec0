"""callweave: call-graph, search and analysis-history analytics as Spark jobs.

Every public function takes and returns DataFrames (or Columns); nothing is held
in hidden state and nothing whole is passed through the driver.
"""

__version__ = "0.1.0"
