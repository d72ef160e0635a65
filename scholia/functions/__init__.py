"""scholia.functions"""
