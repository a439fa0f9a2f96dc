"""tallywick: transaction risk scoring by nearest labelled neighbours, as DataFrame operations."""
