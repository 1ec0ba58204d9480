"""Football match-event analytics as Spark DataFrame operators.

Everything takes DataFrames and returns DataFrames; nothing is collected to the
driver.  See README.md for the layout and the operator list.
"""
