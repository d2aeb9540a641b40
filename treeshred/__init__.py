"""A PySpark-native engine for XML documents: documents are shredded into a relation of nodes, and navigation, XPath,
well-formedness, equality and writing are DataFrame plans over it."""
