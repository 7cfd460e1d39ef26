"""factlode.functions"""
