"""Training-data operators over the `documents` table and their registered queries."""
